"""Statements before they run: kind and tables, plan text, execution with errors kept apart."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

#: The parser's node names of statements that change rows.
CHANGES = {"InsertIntoStatement": "INSERT", "UpdateTable": "UPDATE", "DeleteFromTable": "DELETE"}
#: Nodes of queries that aren't one SELECT.
SET_OPERATIONS = {"Union", "Except", "Intersect"}


class StatementError(ValueError):
    pass


@dataclass(frozen=True)
class LogicalPlan:
    query_type: str
    table_names: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Reply:
    success: bool
    message: str


def _seq(items) -> list:  # noqa: ANN001  a Scala Seq
    return [items.apply(k) for k in range(items.size())]


def _tables(plan, bound: frozenset[str], out: list[str]) -> None:  # noqa: ANN001
    """Base tables in text order; names of common table expressions are none."""
    name = plan.getClass().getSimpleName()
    if name == "UnresolvedWith":
        inner = set(bound)
        for pair in _seq(plan.cteRelations()):
            recursive = inner | {pair._1().lower()} if plan.allowRecursion() else inner
            _tables(pair._2(), frozenset(recursive), out)
            inner.add(pair._1().lower())
        _tables(plan.child(), frozenset(inner), out)
        return
    if name == "UnresolvedRelation":
        parts = _seq(plan.multipartIdentifier())
        if len(parts) > 1 or parts[0].lower() not in bound:
            out.append(parts[-1])
        return
    for child in _seq(plan.children()):
        _tables(child, bound, out)
    for expression in _seq(plan.expressions()):
        _subqueries(expression, bound, out)


def _subqueries(expression, bound: frozenset[str], out: list[str]) -> None:  # noqa: ANN001
    """Tables of the queries inside an expression: those of its parts that hold a plan."""
    parts = expression.productIterator()
    while parts.hasNext():
        part = parts.next()
        if hasattr(part, "getClass") and _PLAN in _ancestors(part.getClass()):
            _tables(part, bound, out)
    for child in _seq(expression.children()):
        _subqueries(child, bound, out)


_PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"


def _ancestors(kind) -> set[str]:  # noqa: ANN001  a Java class
    names = set()
    while kind is not None:
        names.add(kind.getName())
        kind = kind.getSuperclass()
    return names


def summarize(spark: SparkSession, text: str) -> LogicalPlan:
    """SELECT with all its base tables, or INSERT, UPDATE, DELETE with none; any other statement is an error.

    Tables are named without their qualifiers, in the order of the text, as often
    as it names them. Names are not resolved, so unknown columns are no error.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise StatementError(f"syntax error in SQL: {e.getMessage()}") from e
    name = plan.getClass().getSimpleName()
    if name in CHANGES:
        return LogicalPlan(CHANGES[name])
    root = plan
    while root.getClass().getSimpleName() in ("Sort", "GlobalLimit", "LocalLimit", "Offset", "UnresolvedWith", "Distinct"):
        inside = _seq(root.children())
        if root.getClass().getSimpleName() == "Distinct" and inside[0].getClass().getSimpleName() in SET_OPERATIONS:
            break
        root = root.child()
    kind = root.getClass().getSimpleName()
    command = any(c in plan.getClass().getName() for c in (".command.", ".execution.datasources.")) or kind.startswith(("Create", "Drop", "Alter", "Replace", "Set", "Show", "Describe", "Truncate", "Merge", "Cache", "Refresh", "Use", "Explain"))
    if command or kind in SET_OPERATIONS or kind == "Distinct" and _seq(root.children())[0].getClass().getSimpleName() in SET_OPERATIONS:
        raise StatementError("unsupported SQL statement type")
    tables: list[str] = []
    _tables(plan, frozenset(), tables)
    return LogicalPlan("SELECT", tables)


class PlanService:
    """Submit, optimize and execute statements by id, each answered with success and a text."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.submitted: dict[str, str] = {}

    def submit_plan(self, query_id: str, text: str) -> Reply:
        try:
            plan = summarize(self.spark, text)
        except StatementError as e:
            return Reply(False, str(e))
        self.submitted[query_id] = text
        return Reply(True, json.dumps(asdict(plan)))

    def optimize(self, query_id: str) -> Reply:
        """The optimized plan as JSON."""
        if query_id not in self.submitted:
            return Reply(False, f"unknown query: {query_id}")
        try:
            execution = self.spark.sql(self.submitted[query_id])._jdf.queryExecution()
        except AnalysisException as e:
            return Reply(False, e.getMessage())
        return Reply(True, json.dumps({"type": execution.sparkPlan().nodeName(), "plan": execution.optimizedPlan().toString()}))

    def execute_plan(self, query_id: str, out: str | None = None) -> Reply:
        """The whole result as JSON lines, fetched a partition at a time.

        With ``out``, results of any size are written there as JSON files by the
        tasks that compute them, and the reply names the folder and the rows.
        """
        if query_id not in self.submitted:
            return Reply(False, f"unknown query: {query_id}")
        text = self.submitted[query_id]
        kind = summarize(self.spark, text).query_type
        if kind != "SELECT":
            return Reply(False, f"{kind} is not supported: attached tables are read-only")
        try:
            frame = self.spark.sql(text)
            if out is not None:
                frame.write.json(out)
                return Reply(True, json.dumps({"path": out, "rows": self.spark.read.text(out).count()}))
            rows = [r[0] for r in frame.selectExpr("to_json(struct(*))").toLocalIterator()]
        except Exception as e:  # noqa: BLE001  the reply carries any failure of the query
            return Reply(False, str(e))
        return Reply(True, "\n".join(rows))

    def apply(self, statements: Iterable[str]) -> list[Reply]:
        """Each statement in turn; one that fails doesn't keep the next from running."""
        replies = []
        for k, text in enumerate(statements):
            name = f"log-{k}"
            reply = self.submit_plan(name, text)
            replies.append(self.execute_plan(name) if reply.success else reply)
        return replies
