"""Read-only SQL over a fixed set of views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


class QueryRejected(ValueError):
    """The text is not a plain read of the registered views."""


# Names of plan nodes that hold rows without naming a relation, and of expressions that call into the runtime.
OWN_ROWS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}
RUNTIME_CALLS = {"CallMethodViaReflection", "TryReflect"}
_NO_CATALOG = "gateway_without_tables"


def _items(scala_seq: JavaObject) -> Iterator[JavaObject]:
    return (scala_seq.apply(i) for i in range(scala_seq.size()))


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().removesuffix("$")


def _calls(expression: JavaObject) -> Iterator[str]:
    """Names of all expressions in this one."""
    yield _kind(expression)
    for child in _items(expression.children()):
        yield from _calls(child)


class ReadOnlySql:
    """Answers SELECT / WITH text inside an isolated session.

    * The text runs as a subquery, which the grammar allows for queries only: statements
      that change anything do not parse, and nothing of them is executed.
    * The session holds only the views that ``register`` creates. Its default catalog does
      not exist and files cannot be named as tables, so no other relation resolves.
    * The analysed plan is walked before anything runs: every relation must be one of those views,
      and no expression may call into the runtime. Words inside texts and column names do not matter.
    """

    def __init__(self, spark: SparkSession, register: Callable[[SparkSession], object]):
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
        register(self.session)
        self.names = {t.name for t in self.session.catalog.listTables() if t.isTemporary}
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.session.conf.set("spark.sql.defaultCatalog", _NO_CATALOG)

    def _check(self, plan: JavaObject) -> None:
        kind = _kind(plan)
        if kind == "View":
            name = plan.desc().identifier()
            if name.database().isDefined() or name.table() not in self.names:
                raise QueryRejected(f"{name.unquotedString()} is not a registered view")
            return  # what a view reads is its own business
        for expression in _items(plan.expressions()):
            found = RUNTIME_CALLS.intersection(_calls(expression))
            if found:
                raise QueryRejected(f"calls into the runtime are not allowed: {sorted(found)}")
        below = [*_items(plan.children()), *_items(plan.subqueries())]
        if plan.children().isEmpty() and kind not in OWN_ROWS:
            raise QueryRejected(f"only registered views can be read, not {kind}")
        for node in below:
            self._check(node)

    def query(self, text: str) -> DataFrame:
        try:
            found = self.session.sql(f"SELECT * FROM (\n{text.rstrip().rstrip(';')}\n)")
        except Exception as error:
            raise QueryRejected(f"only valid reads of the registered views are allowed: {error}") from error
        self._check(found._jdf.queryExecution().analyzed())
        return found
