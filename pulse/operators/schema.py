"""Bringing input columns to one schema: by name, by name rules, by content.

Renaming is plan-time (no data moves). Inference by content measures every
column in ONE aggregate pass (share of digit-only values, share of known
labels, mean length, distinct count) and returns a table of one row per
input column; only that small table - its size is the number of columns -
is brought to the driver to pick the renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.text import KNOWN_LABELS

CANONICAL = ["tweet_id", "entity", "sentiment", "tweet_content"]
# The reference's header names and its rename rules.
REFERENCE_NAMES = ["Tweet ID", "Entity", "Sentiment", "Tweet content"]
TO_CANONICAL = dict(zip(REFERENCE_NAMES, CANONICAL))
NAME_RULES = [
    ("Tweet ID", lambda lc: lc == "id" or lc.endswith("id") or "tweet id" in lc),
    ("Entity", lambda lc: "entity" in lc or "brand" in lc or "target" in lc),
    ("Sentiment", lambda lc: "sentiment" in lc or "label" in lc or "polarity" in lc),
    ("Tweet content", lambda lc: "content" in lc or "tweet" in lc or "text" in lc),
]
ID_DIGIT_SHARE = 0.9
LABEL_SHARE_MIN = 0.05
ENTITY_MAX_LEN = 40
ENTITY_MIN_DISTINCT_CAP = 5000
ENTITY_TARGET_DISTINCT = 50


def strip_names(df: DataFrame) -> DataFrame:
    """Remove leading and trailing white space from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def canonical(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Strip names, then select and rename ``mapping`` (source -> target),
    matching source names case-insensitively, as Spark resolves them."""
    mapping = TO_CANONICAL if mapping is None else mapping
    df = strip_names(df)
    lower = {c.lower(): c for c in df.columns}
    cols = []
    for src, dst in mapping.items():
        if src.lower() not in lower:
            raise ValueError(f"column {src!r} not found; columns are {df.columns}")
        cols.append(F.col(f"`{lower[src.lower()]}`").alias(dst))
    return df.select(*cols)


def infer_by_name(df: DataFrame) -> DataFrame:
    """Rename columns to the reference's names by the first matching rule
    (id, entity, sentiment, content - in that order). Fails when two columns
    would get the same name, naming both."""
    df = strip_names(df)
    renames: dict[str, str] = {}
    for c in df.columns:
        lc = c.lower()
        for target, rule in NAME_RULES:
            if rule(lc):
                renames[c] = target
                break
    targets: dict[str, str] = {}
    for src, dst in renames.items():
        if dst in targets:
            raise ValueError(f"columns {targets[dst]!r} and {src!r} both map to {dst!r}")
        targets[dst] = src
    return df.withColumnsRenamed(renames) if renames else df


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; columns found: {df.columns}")
    return df


def as_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast columns to string; NULL stays NULL."""
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in cols})


def content_metrics(df: DataFrame) -> DataFrame:
    """One row per column: position, column, digit_share, label_share,
    mean_len, n_distinct, rows, over all rows (NULL read as '').

    The shares and lengths are plain means, from one pass without a shuffle of
    cells; their one row goes to the driver. Different values are counted in
    every column: the values of columns too long to name an entity by their
    SHA-256, so that the expansion that exact counts need never carries a text."""
    names = df.columns
    v = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    means = df.agg(F.count(F.lit(1)).alias("rows"), *[m for i, c in enumerate(v) for m in (
        F.avg(c.rlike("^[0-9]+$").cast("double")).alias(f"d{i}"),
        F.avg(F.lower(c).isin(KNOWN_LABELS).cast("double")).alias(f"l{i}"),
        F.avg(F.length(c).cast("double")).alias(f"m{i}"))]).first()
    short = [(means[f"m{i}"] or 0.0) < ENTITY_MAX_LEN for i in range(len(names))]
    counts = df.agg(*[F.countDistinct(c if s else F.unhex(F.sha2(c, 256))).alias(f"u{i}")
                      for i, (c, s) in enumerate(zip(v, short, strict=True))]).first()
    return df.sparkSession.createDataFrame(
        [(i, c, means[f"d{i}"], means[f"l{i}"], means[f"m{i}"], counts[f"u{i}"], means["rows"]) for i, c in enumerate(names)],
        "position int, column string, digit_share double, label_share double, mean_len double, n_distinct long, rows long")


def with_roles(metrics: DataFrame) -> DataFrame:
    """The metrics (one row per input column, a schema's size) with ``earned``,
    the roles a column earns, and ``role``, the last of them: id = first column
    with > 90 % digit-only values; sentiment = the largest label share if >= 5 %;
    content = the largest mean length; entity = among the rest, 1 < distinct <
    max(5000, rows / 2) and mean length < 40, the one nearest to 50 distinct
    values. Ties go to the first column."""
    every = Window.partitionBy(F.lit(0))
    first = lambda ok, *order: F.row_number().over(every.orderBy(F.when(ok, 0).otherwise(1), *order))
    is_id = F.coalesce(F.col("digit_share") > ID_DIGIT_SHARE, F.lit(False))
    is_label = F.coalesce(F.col("label_share") >= LABEL_SHARE_MIN, F.lit(False))
    m = (metrics.withColumn("_id", (first(is_id, "position") == 1) & is_id)
         .withColumn("_label", (first(is_label, F.desc("label_share"), "position") == 1) & is_label)
         .withColumn("_text", first(F.lit(True), F.desc("mean_len"), "position") == 1))
    free = (~F.col("_id") & ~F.col("_label") & ~F.col("_text") & F.coalesce(
        (F.col("n_distinct") > 1)
        & (F.col("n_distinct") < F.greatest(F.lit(ENTITY_MIN_DISTINCT_CAP), F.floor(F.col("rows") / 2)))
        & (F.col("mean_len") < ENTITY_MAX_LEN), F.lit(False)))
    m = m.withColumn("_entity", (first(free, F.abs(F.col("n_distinct") - ENTITY_TARGET_DISTINCT), "position") == 1) & free)
    earned = F.filter(F.array(*[F.when(F.col(c), F.lit(role)) for c, role in
                                (("_id", "Tweet ID"), ("_label", "Sentiment"), ("_text", "Tweet content"), ("_entity", "Entity"))]),
                      lambda r: r.isNotNull())
    m = m.withColumn("earned", earned).withColumn("role", F.when(F.size("earned") > 0, F.element_at("earned", -1)))
    return m.drop("_id", "_label", "_text", "_entity")


def infer_by_content(df: DataFrame) -> DataFrame:
    """Rename columns by their content when names say nothing (headerless
    input). Brings one row per column to the driver, then renames."""
    roles = with_roles(content_metrics(df)).where("role IS NOT NULL").collect()
    return df.withColumnsRenamed({r["column"]: r["role"] for r in roles})


def resolve_roles(df: DataFrame) -> DataFrame:
    """Names first, content second: rename by the name rules, then, if roles
    are still missing, measure only the columns no rule named (one aggregate
    pass) and give them the missing roles; finally check all four are there.
    Columns already named by a rule are never renamed by content."""
    named = infer_by_name(df)
    missing = [r for r in REFERENCE_NAMES if r not in named.columns]
    if missing:
        rest = [c for c in named.columns if c not in REFERENCE_NAMES]
        if rest:
            found = with_roles(content_metrics(named.select(*[F.col(f"`{c}`") for c in rest]))).collect()
            src_of = {}
            for r in found:
                wanted = [x for x in r["earned"] if x in missing]
                if wanted:
                    src_of[r["column"]] = wanted[0]  # one column takes one role
            named = named.withColumnsRenamed(src_of)
    return require_columns(named, REFERENCE_NAMES)
