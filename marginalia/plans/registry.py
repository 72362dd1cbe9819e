"""Every query over documents and pages: an operator's SQL, with the views it reads, run by Spark or written for DuckDB.

An operator is a SELECT over named inputs. ``plan`` finds the inputs that are views of this package, adds them as common
table expressions in the order in which they depend on each other, and leaves the given tables to the catalogue. With
``apply`` any input can be a DataFrame of the user's instead.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Collection, Mapping
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from marginalia.functions.dialect import DUCK, SPARK, Spark
from marginalia.operators import ALWAYS, BUILT, BY, OPERATORS, STORED, VIEWS
from marginalia.sources.files import saved

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@cache
def fixtures() -> dict[str, str]:
    """Name to SELECT of the views in fixtures.sql."""
    text = re.sub(r"--[^\n]*", "", (Path(__file__).parent / "fixtures.sql").read_text())
    return dict(re.findall(r"create view (\w+) as\s+(.*?);\s*(?=\n|$)", text + "\n", re.S))


def definition(name: str, d: Spark) -> str | None:
    if name in VIEWS:
        return VIEWS[name](d)
    return fixtures().get(name)


def _end(sql: str, at: int) -> int:
    """Where the bracket that opens just before ``at`` has closed."""
    depth = 1
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[at], 0)
        at += 1
    return at


def alike(sql: str) -> str:
    """Counts and row numbers in the form that both engines type and fill alike."""
    while (at := sql.find("count_if(")) >= 0:
        end = _end(sql, at + 9)
        sql = f"{sql[:at]}count(case when {sql[at + 9 : end - 1]} then 1 end){sql[end:]}"
    for m in reversed(list(re.finditer(r"(?<!cast\()row_number\(\) over \(", sql))):
        end = _end(sql, m.end())
        sql = f"{sql[: m.start()]}cast({sql[m.start() : end]} as bigint){sql[end:]}"
    return sql


def sources(sql: str) -> dict[str, None]:
    """Names that stand where a table does, in order; what is quoted does not count."""
    return dict.fromkeys(re.findall(r"\b(?:from|join)\s+([a-z]\w*)", re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)))


def needed(body: str, d: Spark, given: Collection[str] = ()) -> dict[str, str]:
    """Name to SELECT of every view that the body rests on, but for those given, each after what it reads."""
    done: dict[str, str] = {}

    def add(sql: str, within: str = "") -> None:
        for name in sources(sql):
            if name in done or name in given or name == within or (text := definition(name, d)) is None:
                continue
            add(text, name)
            done.setdefault(name, text)

    add(body)
    return done


def plan(body: str, d: Spark, given: Mapping[str, str] | None = None) -> str:
    """The body with every view that it needs as common table expressions. ``given``: names to the tables that stand for them."""
    given = given or {}
    done = {n: f"select * from {t}" for n, t in given.items()} | needed(body, d, given)
    found = re.match(r"\s*with\s+(recursive\s+)?", body)
    own, rest = ("", body) if not found else ("recursive " if found[1] else "", body[found.end() :])
    recursive = "recursive " if own or any(n in sources(t) for n, t in done.items()) else ""
    views = ", ".join(f"{n} as ({t})" for n, t in done.items())
    if found:
        return alike(f"with {recursive}{views}{', ' if views else ''}{rest}")
    return alike(f"with {recursive}{views} {body}" if views else body)


def _over(spark: SparkSession, body: str, inputs: Mapping[str, DataFrame], made: Callable[[str], DataFrame]) -> DataFrame:
    """What is made of the body's SQL over its inputs, which have names of their own in the session only while it is analysed."""
    names = {key: f"marginalia_{uuid.uuid4().hex}" for key in inputs}
    for key, df in inputs.items():
        df.createOrReplaceTempView(names[key])
    try:
        return made(plan(body, SPARK, names))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def _sql(spark: SparkSession, body: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """The body over its inputs.

    Recursive walks end by themselves, so the session's row limit for them, made for mistakes, is lifted while one runs;
    its rows are written at once, so that the limit is back when the caller goes on.
    """

    def made(sql: str) -> DataFrame:
        if not sql.startswith("with recursive"):
            return spark.sql(sql)
        limit = "spark.sql.cteRecursionRowLimit"
        before = spark.conf.get(limit)
        spark.conf.set(limit, "-1")
        try:
            return saved(spark.sql(sql))
        finally:
            spark.conf.set(limit, before)

    return _over(spark, body, inputs, made)


def run(spark: SparkSession, body: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """The body over its inputs. Views that are built in rounds are made first; those that are marked ``stored`` and read more than once
    are computed once, as tables, before those rounds where they rest on none."""
    inputs = dict(inputs)

    def store(names: list[str]) -> None:
        for name in names:
            rest = needed(body, SPARK, inputs)
            reads = sum(len(re.findall(rf"\b(?:from|join)\s+{name}\b", text)) for text in [body, *rest.values()])
            if name in rest and (reads > 1 or name in ALWAYS):
                select = f"select * from {name}"
                frame = _sql(spark, select, _read(select, inputs))
                inputs[name] = _narrow(spark, body, inputs, name, frame) if name in BY else saved(frame)

    stored = [n for n in needed(body, SPARK, inputs) if n in STORED]
    store([n for n in stored if not any(x in BUILT for x in needed(f"select * from {n}", SPARK, inputs))])
    for name in [n for n in needed(body, SPARK, inputs) if n in BUILT]:
        reads = {r: f"select * from {r}" for r in BUILT[name].reads}
        inputs[name] = BUILT[name](**{r: _sql(spark, select, _read(select, inputs)) for r, select in reads.items()})
    store([n for n in needed(body, SPARK, inputs) if n in STORED])
    return _sql(spark, body, _read(body, inputs))


def _narrow(spark: SparkSession, body: str, inputs: Mapping[str, DataFrame], name: str, frame: DataFrame) -> DataFrame:
    """A view as a table by its key, with the columns that the body reads, and nulls for the others. Tables made after it are read whole."""
    rest = needed(body, SPARK, inputs)
    made = {v for n in rest for v in ([n] if n in STORED and n != name else BUILT[n].reads if n in BUILT else ())}
    readers = [f"select * from {v}" for v in sorted(made) if v == name or name in needed(f"select * from {v}", SPARK, inputs)]
    if any(n in BUILT for b in (body, *readers) for n in needed(b, SPARK, inputs)):
        used = set(frame.columns)  # what such a view gives is known when it is made
    else:
        used = {BY[name]}.union(*[_columns_read(spark, b, inputs, name, frame) for b in (body, *readers)])
    table = saved(frame.select([c for c in frame.columns if c in used]), BY[name])
    return table.select([F.col(c) if c in used else F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in frame.columns])


def _columns_read(spark: SparkSession, body: str, inputs: Mapping[str, DataFrame], name: str, frame: DataFrame) -> set[str]:
    """The columns of a view that are left in the body's plan when Spark has optimised it; all where the plan does not show the view."""
    own = {f"{uuid.uuid4().hex}_{c}": c for c in frame.columns}
    # rows that Spark knows nothing of, under names that no other input has
    kinds = StructType([StructField(o, frame.schema[c].dataType) for o, c in own.items()])
    stand_in = spark.createDataFrame(spark.sparkContext.emptyRDD(), kinds).select([F.col(o).alias(c) for o, c in own.items()])
    read = _read(body, {**inputs, name: stand_in})
    todo, found = [_over(spark, body, read, spark.sql)._jdf.queryExecution().optimizedPlan()], set()
    sequence = lambda s: [s.apply(i) for i in range(s.size())]
    while todo:
        node = todo.pop()
        below = sequence(node.children())
        todo += below + sequence(node.subqueries())
        # a union hands on what its inputs give, by position
        found |= {a.name() for a in sequence(node.references().toSeq()) + [a for n in below if "Union" in node.nodeName() for a in sequence(n.output())]}
    return {c for o, c in own.items() if o in found} or set(frame.columns)


def _read(body: str, inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Those of the inputs that the body rests on."""
    texts = [body, *needed(body, SPARK, inputs).values()]
    return {name: df for name, df in inputs.items() if any(name in sources(t) for t in texts)}


def apply(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """The operator over the given inputs; what is not given is built from the catalogue's tables."""
    return run(spark, OPERATORS[name](SPARK), inputs)


def tables(spark: SparkSession, sf_dir: str, body: str) -> dict[str, DataFrame]:
    """The given tables that the body rests on."""
    texts = [body, *needed(body, SPARK).values()]
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES if any(name in sources(t) for t in texts)}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = OPERATORS[name](SPARK)
        return run(spark, body, tables(spark, sf_dir, body))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from marginalia.sources import files
    from marginalia.streaming import arrivals

    jobs = (files.decode_audit, files.corpus_writer, arrivals.stream_latest, arrivals.stream_checks)
    return {name: _query(name) for name in OPERATORS} | {f.__name__: f for f in jobs}


def oracle_sql() -> dict[str, str]:
    from marginalia.sources import files

    out = {name: plan(f(DUCK), DUCK) for name, f in OPERATORS.items()}
    out["decode_audit"] = files.DECODE_SQL
    # the streams end with what the batch forms give
    out["stream_latest"], out["stream_checks"] = out["latest_snapshot"], out["page_findings"]
    out["corpus_writer"] = "select source, count(*) docs, cast(sum(length(text)) as bigint) n_chars from documents group by source"
    return out
