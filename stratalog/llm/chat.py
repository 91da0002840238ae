"""Chat formatting by token-level assembly.

Each text is encoded as a segment of its own, and turns are assembled from segments and reserved ids that no text
can produce, which follow the tokenizer's vocabulary: a marker for the role, and one for the end of the turn.  As text, the
markers read

    ### Assistant: TEXT </turn>\\n

and control strings inside texts get a backslash before them (backslashes that already stand there are part
of the control string), so that the text form can be read back as well (``parse``).  The loss mask comes from a prefix
sum over the ids, which counts role markers and end markers before each.

Turns are encoded in any order and on any machine; only then are conversations put in order, and their ids
are passed on turn by turn, so the memory needed doesn't depend on the length of a conversation.

Defined results: null text is empty; a null role is the empty role; rows of a null conv_id are one conversation;
equal (conv_id, turn) rows are ordered by role, then a hash of the text; repeated rows are turns of their own; very long
texts are one turn each, held whole by one task; other columns are not looked at, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

ROLES = ("user", "assistant", "system", "tool")
#: The text forms of the markers: for each role, for any other one, after the name of that, and at the end of a turn.
MARKERS = (*(f"### {r.capitalize()}: " for r in ROLES), "### Role ", ": ", " </turn>\n")
OTHER, COLON, END = len(ROLES), len(ROLES) + 1, len(ROLES) + 2
CONTROL = re.compile(r"\\*(?:### (?:User|Assistant|System|Tool):|### Role |</turn>)")
#: In the name of another role single characters are escaped, for it ends with the first bare colon.
ODD_ROLE = re.compile(r"(?:[^\\:]|\\.)*", re.S)
HEADER = re.compile(r"### (?:(User|Assistant|System|Tool): |Role )")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0].removeprefix("\\"), text)


def escape_role(name: str) -> str:
    return re.sub(r"[\\:#<]", r"\\\g<0>", name)


def unescape_role(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name, flags=re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a text form."""
    turns, at = [], 0
    while at < len(text):
        head = HEADER.match(text, at)
        end = text.find(MARKERS[END], at)
        if not head or end < 0:
            raise ValueError(f"no whole turn at {at}")
        at, role = head.end(), (head[1] or "").lower()
        if not head[1]:
            name = ODD_ROLE.match(text, at)
            role, at = unescape_role(name[0]), name.end() + len(MARKERS[COLON])
            end = text.find(MARKERS[END], at)
        turns.append((role, unescape(text[at:end])))
        at = end + len(MARKERS[END])
    return turns


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Assembler:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.first = self.tokenizer.get_vocab_size()

    def turns(self, roles: list[str], texts: list[str]) -> list[np.ndarray]:
        """Ids of turns."""
        encode = lambda many: [e.ids for e in self.tokenizer.encode_batch_fast(many, add_special_tokens=False)]
        odd = {r: ids for r, ids in zip(names, encode([escape_role(r) for r in names]), strict=True)} if (names := sorted({*roles} - {*ROLES})) else {}
        head = lambda r: [self.first + ROLES.index(r)] if r in ROLES else [self.first + OTHER, *odd[r], self.first + COLON]
        return [np.array([*head(r), *ids, self.first + END], np.uint32) for r, ids in zip(roles, encode([escape(t) for t in texts]), strict=True)]

    def read_turns(self, turns: list[np.ndarray]) -> list[tuple[str, str, str, str]]:
        """Role, text, text under the loss mask (all unescaped), and text form of each turn; each segment is decoded once."""
        ends = [len(x) - 1 for x in turns]
        starts = [1 + (int(np.flatnonzero(x == self.first + COLON)[0]) if x[0] == self.first + OTHER else 0) for x in turns]
        masks = [loss_mask(x, self.first) for x in turns]
        whole = [bool(m[i:j].all()) for m, i, j in zip(masks, starts, ends, strict=True)]
        parts = [[x[1 : i - 1], x[i:j], x[:0] if w else x[m]] for x, i, j, m, w in zip(turns, starts, ends, masks, whole, strict=True)]
        flat = [p.tolist() for p in chain.from_iterable(parts)]
        some = [p for p in flat if p]
        found = iter(self.tokenizer.decode_batch(some, skip_special_tokens=False) if some else [])
        texts = [next(found) if p else "" for p in flat]
        out = []
        for x, w, m, name, text, loss in zip(turns, whole, masks, texts[::3], texts[1::3], texts[2::3], strict=True):
            kind = int(x[0]) - self.first
            form = MARKERS[kind] + (name + MARKERS[COLON] if kind == OTHER else "") + text + MARKERS[END]
            own = unescape(text)
            out.append((unescape_role(name) if kind == OTHER else ROLES[kind], own, (own if w and m.any() else "") if w else unescape(loss), form))
        return out


def loss_mask(ids: np.ndarray, first: int) -> np.ndarray:
    """True for the ids between an assistant's marker and the end of its turn; reserved ids begin at ``first``."""
    starts = (ids >= first) & (ids <= first + OTHER)
    # since the last role marker: is it the assistant's, and has no end marker come
    turn = np.cumsum(starts)
    assistant = np.concatenate([[False], ids[starts] == first + ROLES.index("assistant")])
    ended = np.cumsum(ids == first + END)
    before = np.concatenate([[0], ended[starts]])
    return assistant[turn] & (ended == before[turn]) & ~starts


def formatted(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text_order, ids): a row for each turn, ids as little-endian 32-bit integers."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("tie", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = Assembler(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                roles, texts = ([x or "" for x in b[c].to_pylist()] for c in ("role", "text"))
                ids = [x.astype("<u4").tobytes() for x in build.turns(roles, texts)]
                ties = [f"{r}\n{hashlib.sha256(t.encode()).hexdigest()}" for r, t in zip(roles, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b["conv_id"].cast(pa.int64()), b["turn"].cast(pa.int64()), pa.array(ties), pa.array(ids, pa.binary())], schema=schema)

    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return saved(given.mapInArrow(run, "conv_id long, turn long, tie string, ids binary"), "chat-turns")


def read_back(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of each conversation, from its ids alone."""
    path = tokenizer or default_tokenizer()
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids")
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build, now, done = Assembler(path), None, []

        def close() -> None:
            if now is not None:
                done.append((now["conv_id"], now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["ids"]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            turns = [np.frombuffer(data.as_buffer(), "<u4") for data in batch["ids"]]
            for conv_id, ids, (role, text, loss, whole) in zip(batch["conv_id"].to_pylist(), turns, build.read_turns(turns), strict=True):
                if now is None or now["conv_id"] != conv_id:
                    close()
                    now = {"conv_id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "ids": 0}
                now["turns"].update(f"{role}\n{text}\n".encode())
                now["loss"].update(loss.encode())
                now["n"] += 1
                now["loss_chars"] += len(loss)
                now["chars"] += len(whole)
                now["ids"] += len(ids)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie").select("conv_id", "ids")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long")


def round_trip(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_back(formatted(conversations, tokenizer), tokenizer)
