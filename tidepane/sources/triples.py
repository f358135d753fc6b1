"""Triples as text, as rows ``(s, p, o, o_type, g)``, and as wide observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepane.functions.messages import HAS_VALUE, SAREF, XSD_FLOAT
from tidepane.functions.timegrid import from_micros, micros

# Predicates and classes of an observation.
IN_DATASET = "http://rdfs.org/ns/void#inDataset"
MADE_BY = SAREF + "measurementMadeBy"
VERSION_OF = "http://purl.org/dc/terms/isVersionOf"
PROPERTY = SAREF + "relatesToProperty"
TIMESTAMP = SAREF + "hasTimestamp"
XSD_DATETIME = "http://www.w3.org/2001/XMLSchema#dateTime"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"

IRI = "iri"
BLANK = "blank"

_NODE = r"(?:<[^>]*>|_:[A-Za-z0-9_.\-]*[A-Za-z0-9_\-])"
_LITERAL = r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z][A-Za-z0-9\-]*)?'
_STATEMENT = rf"{_NODE}\s*<[^>]*>\s*(?:{_NODE}|{_LITERAL})\s*(?:{_NODE}\s*)?\."
_PARTS = rf"^({_NODE})\s*<([^>]*)>\s*({_NODE}|{_LITERAL})\s*({_NODE})?\s*\.$"

OBSERVATION_COLUMNS = [
    "subject", "dataset", "device", "obs_type", "property", "ts", "value", "topic",
]


def _bare(node):
    return F.regexp_replace(node, r"^<|>$", "")


def parse_nt(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Statements in text lines, any number per line, as triple rows; other text is skipped.

    ``o_type`` is ``iri``, ``blank`` or the data type of the literal; a fourth term becomes ``g``.
    """
    statement = F.explode(F.regexp_extract_all(line, F.lit(f"({_STATEMENT})"), F.lit(1)))
    rows = lines.select(*keep, statement.alias("_st"))
    s, p, o, g = (F.regexp_extract("_st", _PARTS, i) for i in (1, 2, 3, 4))
    rows = rows.select(*keep, _bare(s).alias("s"), p.alias("p"), o.alias("_o"), g.alias("_g"))
    literal = F.col("_o").startswith('"')
    datatype = F.regexp_extract("_o", r'"\^\^<([^>]*)>$', 1)
    text = F.regexp_extract("_o", r'^"((?:[^"\\]|\\.)*)"', 1)
    return rows.select(
        *keep,
        "s",
        "p",
        F.when(literal, F.regexp_replace(text, r'\\(["\\])', "$1")).otherwise(_bare(F.col("_o"))).alias("o"),
        F.when(literal, F.when(datatype == "", XSD_STRING).otherwise(datatype))
        .when(F.col("_o").startswith("_:"), BLANK)
        .otherwise(IRI)
        .alias("o_type"),
        F.when(F.col("_g") != "", _bare(F.col("_g"))).alias("g"),
    )


def read_nt(spark: SparkSession, path: str) -> DataFrame:
    """Triples in N-Triples or N-Quads files (a file, folder or glob)."""
    return parse_nt(spark.read.text(path))


def nt_statement(s: Column, p: Column, o: Column, o_type: Column) -> Column:
    """One triple as text."""
    def node(col):
        return F.when(col.startswith("_:"), col).otherwise(F.concat(F.lit("<"), col, F.lit(">")))

    escaped = F.regexp_replace(o, r'(["\\])', r"\\$1")
    literal = F.concat(F.lit('"'), escaped, F.lit('"^^<'), o_type, F.lit(">"))
    term = F.when(o_type.isin(IRI, BLANK), node(o)).otherwise(literal)
    return F.concat(node(s), F.lit(" <"), p, F.lit("> "), term, F.lit(" ."))


def _terms() -> list[tuple[str, Column, str]]:
    """Predicate, object and object type of the six statements of an observation."""
    stamp = F.concat(F.date_format(from_micros(micros("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return [
        (IN_DATASET, F.col("dataset"), IRI),
        (MADE_BY, F.col("device"), IRI),
        (VERSION_OF, F.col("obs_type"), IRI),
        (PROPERTY, F.col("property"), IRI),
        (TIMESTAMP, stamp, XSD_DATETIME),
        (HAS_VALUE, F.col("value").cast("string"), XSD_FLOAT),
    ]


def to_lines(obs: DataFrame) -> DataFrame:
    """Observations as text, the six statements of a subject on one line. No shuffle."""
    texts = [nt_statement(F.col("subject"), F.lit(p), o, F.lit(kind)) for p, o, kind in _terms()]
    return obs.select(F.concat_ws(" ", *texts).alias("value"))


def write_nt(triples: DataFrame, path: str) -> None:
    """One statement per line; no shuffle."""
    triples.select(
        nt_statement(F.col("s"), F.col("p"), F.col("o"), F.col("o_type")).alias("value")
    ).write.text(path)


def to_observations(triples: DataFrame, topic: str | None = None) -> DataFrame:
    """Wide observations: one row per subject. The topic is the graph, or ``topic`` if given."""
    def of(predicate):
        return F.max(F.when(F.col("p") == predicate, F.col("o")))

    wide = triples.groupBy("s").agg(
        of(IN_DATASET).alias("dataset"),
        of(MADE_BY).alias("device"),
        of(VERSION_OF).alias("obs_type"),
        of(PROPERTY).alias("property"),
        F.regexp_replace(of(TIMESTAMP), "Z$", "").try_cast("timestamp_ntz").alias("ts"),
        of(HAS_VALUE).try_cast("double").alias("value"),
        F.max("g").alias("topic"),
    )
    if topic is not None:
        wide = wide.withColumn("topic", F.lit(topic))
    return wide.withColumnRenamed("s", "subject").select(*OBSERVATION_COLUMNS)


def to_triples(obs: DataFrame) -> DataFrame:
    """Six triples per observation, with the topic as graph. A narrow step: no shuffle."""
    po = F.array(
        *[
            F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_type"))
            for p, o, kind in _terms()
        ]
    )
    return obs.select(
        F.col("subject").alias("s"), F.explode(po).alias("_t"), F.col("topic").alias("g")
    ).select("s", "_t.p", "_t.o", "_t.o_type", "g")
