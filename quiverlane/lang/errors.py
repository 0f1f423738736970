"""What can go wrong with a query, by the stage that finds it. Names are those users know."""

from __future__ import annotations


class QueryError(Exception):
    """Any error of this package. ``str()`` begins with the stage and the name."""

    stage = "Error"

    def __init__(self, message: str = "") -> None:
        self.msg = f"{self.stage}: {type(self).__name__}" + (f": {message}" if message else "")
        super().__init__(self.msg)


class CompileTimeError(QueryError):
    stage = "CompileTime"


class RunTimeError(QueryError):
    stage = "RunTime"


class StoreError(QueryError):
    stage = "StoreError"


class InternalError(QueryError):
    stage = "Internal"


def _kinds(base: type[QueryError], names: str) -> dict[str, type[QueryError]]:
    return {n: type(n, (base,), {}) for n in names.split()}


#: The names of errors of each stage.
CompileTime = _kinds(
    CompileTimeError,
    "FloatingPointOverflow IntegerOverflow ParseError UndefinedVariable VariableAlreadyBound VariableTypeConflict RequiresDirectedRelationship "
    "NoSingleRelationshipType NotComparable UnknownFunction InvalidAggregation ColumnNameConflict InvalidDelete InvalidNumberOfArguments "
    "NonConstantExpression InvalidArgumentType NegativeIntegerArgument",
)
RunTime = _kinds(
    RunTimeError,
    "UnknownParameter InvalidNumberOfArguments InvalidArgument MapElementAccessByNonString NotComparable MissingEdgeLabel UnknownFunction "
    "InvalidBinaryOperands InvalidNegationOperands InvalidDelete DeleteConnectedNode NegativeIntegerArgument InvalidArgumentType OutOfBound "
    "DuplicatedGraph UnknownGraph",
)
Store = _kinds(StoreError, "UnknownBackend UnavailableBackend OpeningError DuplicatedGraph UnknownGraph InvalidFormat")
Internal = _kinds(InternalError, "MissingAggregations Unimplemented UnknownNode UnknownEdge")


def compile_error(name: str, message: str = "") -> CompileTimeError:
    return CompileTime[name](message)


def run_error(name: str, message: str = "") -> RunTimeError:
    return RunTime[name](message)
