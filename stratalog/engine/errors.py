"""What sessions raise."""


class EngineError(Exception):
    """A statement that can't be carried out: unknown names, violated constraints, bad syntax."""


class ConflictError(EngineError):
    """A commit that met another one: on the same key, on what it has read, or in a range that another transaction has scanned."""


class NotSupportedError(EngineError):
    """A statement that is understood but not part of the language."""


class ContractViolation(EngineError):
    """A query that would scan more rows than its budget allows."""


class NotFoundError(EngineError):
    """A key or a time that nothing is known of."""
