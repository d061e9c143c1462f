"""Exceptions."""


class GraphError(Exception):
    """Base of all errors of this package."""


class NotFound(GraphError):
    """A node, edge, index or key does not exist."""


class InvalidInput(GraphError):
    """An argument or a row breaks the data model."""


class QuerySyntax(GraphError):
    """A query text cannot be parsed."""


class CycleDetected(GraphError):
    """An operator for acyclic graphs met a cycle."""

    def __init__(self, cycle: list[int]):
        self.cycle = cycle
        super().__init__("cycle: " + " -> ".join(map(str, cycle)))


class Unsupported(GraphError):
    """The operation is not defined here."""
