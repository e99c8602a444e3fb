"""What changed between consecutive readings of a provider's documents, of any shape, by kind of change.

Documents are VARIANT.  `variant_explode` takes them apart level by level; a table of rules says which paths are compared, as what
kind, and which differences end a comparison.  Both sides of a pair meet in one aggregation by (pair, path), without a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

MISSING, NUMERICAL, PRESENT = "Missingness", "Numerical", "present"


@dataclass(frozen=True)
class DriftRule:
    """How the paths that `pattern` matches as a whole are compared; the first rule that matches a path holds.

    kind: of a change; None: the path is read for `stops` only (the path itself too, if `stops` matches it).  noise: two numbers, neither negative, that differ by no more are a
    Numerical change.  stops: where the path differs, paths that this pattern matches as a whole are not compared in that pair.
    needed: nor are they where one side has no value.
    """

    pattern: str
    kind: str | None
    noise: Decimal | None = None
    stops: str | None = None
    needed: bool = False


@dataclass(frozen=True)
class DatedPaths:
    """Paths of a day's values: `pattern` has the ISO date as its first group.  Only days before the earlier reading began are compared,
    and a day's absence counts only strictly inside what both readings asked for (the paths `first` and `last`)."""

    pattern: str
    first: str
    last: str


def _whole(path: Column, pattern: str) -> Column:
    return path.rlike(f"^(?:{pattern})$")


def _escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _plain(value: Column, shape: Column) -> Column:
    """A scalar's text; of a number that JSON wrote with an exponent (0E-13), which is read as a double, the digits without one."""
    double = F.try_variant_get(value, F.lit("$"), "double")
    exact = double.try_cast("decimal(38,18)")
    size, whole = F.abs(exact), F.floor(F.abs(exact))
    part = F.substring((size - whole + 1).cast("string"), 2, 20)  # "1." and the digits: no text of a small decimal has an exponent then
    digits = F.concat(F.when(exact < 0, "-").otherwise(""), whole.cast("string"), F.regexp_replace(part, "\\.?0+$", ""))
    return F.when((shape == "DOUBLE") & (exact.cast("double") == double), digits).otherwise(value.cast("string"))


def flatten(documents: DataFrame, document: str, members: dict[str, str]) -> DataFrame:
    """documents' other columns with path, value, owners, array: a row for each scalar, of any depth.

    members: for arrays whose path matches a key, the field that names their elements (others are named by position).  Such an element
    also gives `<path>/reported`; owners are the named elements a path lies in, array is the named array of a `reported` row.
    A document that is null gives no rows; a name's `~` and `/` are written `~0` and `~1`.
    """
    spark, rest = documents.sparkSession, [c for c in documents.columns if c != document]
    level = documents.select(*rest, F.lit("").alias("path"), F.array().cast("array<string>").alias("owners"), F.col(document).alias("v"))
    out = []
    while True:
        step = spark.sql(f"SELECT {', '.join(f'`{c}`' for c in rest)}, path, owners, pos, key, value FROM {{level}}, LATERAL variant_explode(v)", level=level)
        named = [F.when(_whole(F.col("path"), p) & F.col("key").isNull(), F.try_variant_get("value", F.lit(f"$.{f}"), "string")) for p, f in members.items()]
        step = step.withColumn("_member", F.coalesce(*named, F.lit(None).cast("string")))
        name = _escaped(F.coalesce("key", "_member", F.col("pos").cast("string")))
        child = F.when(F.col("path") == "", name).otherwise(F.concat_ws("/", "path", name))
        shape = F.schema_of_variant("value")
        step = step.select(*rest, F.col("path").alias("_parent"), child.alias("path"), "owners", F.col("_member").isNotNull().alias("_named"), (shape.startswith("OBJECT") | shape.startswith("ARRAY")).alias("_deep"), shape.alias("_shape"), F.col("value").alias("v"))
        step = kept(step, "document-level")
        none = F.lit(None).cast("string")
        out.append(step.where("not _deep").select(*rest, "path", _plain(F.col("v"), F.col("_shape")).alias("value"), "owners", none.alias("array")))
        out.append(step.where("_named").select(*rest, F.concat("path", F.lit("/reported")).alias("path"), F.lit(PRESENT).alias("value"), "owners", F.col("_parent").alias("array")))
        deep = step.where("_deep")
        if deep.isEmpty():
            return reduce(DataFrame.unionByName, out)
        level = deep.select(*rest, "path", F.when(F.col("_named"), F.concat("owners", F.array("path"))).otherwise(F.col("owners")).alias("owners"), "v")


def comparable_pairs(observations: DataFrame, stream: list[str], evidence: tuple[str, ...]) -> DataFrame:
    """observations with `_sides`: the pairs they stand in, as earlier (0) or later (1) one.

    Consecutive observations of a stream are a pair if both have the same account by the same accepted evidence and the later one began after
    the earlier one was collected.  So another account, a failed identification or an overlapping fetch between two readings is never bridged.
    """
    w = Window.partitionBy(*stream).orderBy("collected_us", "observation_id")
    o = observations.dropDuplicates([*stream, "observation_id"])
    scoped = (F.coalesce("account", F.lit("")) != "") & F.coalesce(F.col("evidence").isin(*evidence), F.lit(False))
    o = o.withColumn("_scoped", scoped)
    b = {c: F.lag(c).over(w) for c in ("observation_id", "account", "evidence", "collected_us", "began_us", "_scoped")}
    fits = F.col("_scoped") & b["_scoped"] & (b["account"] == F.col("account")) & (b["evidence"] == F.col("evidence")) & (b["collected_us"] < F.col("began_us"))
    pair = F.struct(b["observation_id"].alias("before_id"), F.col("observation_id").alias("after_id"), b["began_us"].alias("before_began_us"), F.col("collected_us").alias("observed_us"), "account", *stream)
    o = o.withColumn("_own", F.when(F.coalesce(fits, F.lit(False)), pair)).withColumn("_next", F.lead("_own").over(w))
    sides = F.array(F.struct(F.col("_next").alias("pair"), F.lit(0).alias("side")), F.struct(F.col("_own").alias("pair"), F.lit(1).alias("side")))
    return o.withColumn("_sides", F.filter(sides, lambda s: s["pair"].isNotNull())).where(F.size("_sides") > 0).drop("_scoped", "_own", "_next")


def document_drift(
    observations: DataFrame, stream: list[str], rules: list[DriftRule], members: dict[str, str] | None = None, header: list[str] | None = None,
    dated: DatedPaths | None = None, usable: tuple[str, ...] = ("Available", "Empty"), evidence: tuple[str, ...] = ("ProviderVerified", "ServerCorrelated"),
) -> DataFrame:
    """A row for each field that changed between two consecutive comparable readings: stream, account, before_id, after_id,
    observed_us, kind, field, before, after.

    observations: observation_id, the stream's columns, account, evidence, began_us, collected_us, state, document (VARIANT), and the columns
    of `header`, which are paths `@<column>`.  Documents are compared where both states are usable.  A value that only one side has is
    Missingness whatever its rule; of a named element that only one side has, `<path>/reported` is the one change.  Arrays of which
    two elements have the same name are not compared in that pair.  Paths without a rule are not compared.  Values are compared as
    text, numbers without trailing zeros; a JSON null is no value.
    """
    header = header or []
    o = kept(comparable_pairs(observations, stream, evidence), "document-pairs")
    ok = F.coalesce(F.col("state").isin(*usable), F.lit(False))
    heads = F.array(*(F.struct(F.lit(f"@{c}").alias("path"), F.col(c).cast("string").alias("value")) for c in ["state", *header]), F.struct(F.lit("@usable").alias("path"), ok.cast("string").alias("value")))
    empty = F.array().cast("array<string>")
    top = o.select("_sides", F.explode(heads).alias("h")).select("_sides", "h.path", "h.value", empty.alias("owners"), F.lit(None).cast("string").alias("array"))
    leaves = flatten(o.where(ok).select("_sides", "document"), "document", members or {}).unionByName(top)

    table = [*rules, DriftRule("@state", "Capability"), DriftRule("@usable", None, stops="[^@].*")]
    path = F.col("path")
    rule = F.coalesce(*(F.when(_whole(path, r.pattern), F.lit(i)) for i, r in enumerate(table)))
    range_paths = [dated.first, dated.last] if dated else []
    leaves = leaves.withColumn("_rule", F.when(F.col("array").isNull(), rule)).where(F.col("_rule").isNotNull() | F.col("array").isNotNull() | path.isin(*range_paths))
    at = lambda side, c: F.max(F.when(F.col("s.side") == side, F.col(c)))
    n = lambda side: F.count_if(F.col("s.side") == side)
    g = leaves.withColumn("s", F.explode("_sides")).groupBy("s.pair", "path").agg(
        at(0, "value").alias("before"), at(1, "value").alias("after"), F.greatest(n(0), n(1)).alias("_n"), F.max("_rule").alias("_rule"), F.max("array").alias("array"), F.max("owners").alias("owners"),
    )
    pick = lambda values, kind: F.coalesce(*(F.when(F.col("_rule") == i, F.lit(v)) for i, v in enumerate(values) if v is not None), F.lit(None).cast(kind))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    needed = F.coalesce(pick([r.needed or None for r in table], "boolean"), F.lit(False))
    differs = ~F.col("before").eqNullSafe(F.col("after"))
    g = g.withColumns({"_differs": differs, "_stops": F.when(differs | (needed & (blank(F.col("before")) | blank(F.col("after")))), pick([r.stops for r in table], "string"))})
    g = g.where(F.col("_differs") | F.col("_stops").isNotNull() | (F.col("array").isNotNull() & (F.col("_n") > 1)) | path.isin(*range_paths))

    within = Window.partitionBy("pair")
    g = g.withColumns({
        "_ended": F.collect_set("_stops").over(within),
        "_lost": F.collect_set(F.when(F.col("array").isNotNull() & F.col("_differs"), F.regexp_replace("path", "/reported$", ""))).over(within),
        "_twice": F.collect_set(F.when(F.col("array").isNotNull() & (F.col("_n") > 1), F.col("array"))).over(within),
        **{f"_{c}_{r}": F.max(F.when(path == p, F.col(c).try_cast("date"))).over(within) for r, p in zip(("first", "last"), range_paths) for c in ("before", "after")},
    })
    shown = F.col("_differs") & ~F.exists("_ended", lambda p: F.rlike("path", F.concat(F.lit("^(?:"), p, F.lit(")$")))) & ~F.arrays_overlap("owners", "_lost") & ~F.exists("_twice", lambda a: F.startswith("path", F.concat(a, F.lit("/"))))
    if dated:
        day = F.regexp_extract("path", f"^(?:{dated.pattern})$", 1)
        settled = day.try_cast("date") < F.to_date(F.timestamp_micros(F.col("pair.before_began_us")).cast("timestamp_ntz"))
        inside = reduce(Column.__and__, (day.try_cast("date") > F.col(f"_{c}_first") for c in ("before", "after"))) & reduce(Column.__and__, (day.try_cast("date") < F.col(f"_{c}_last") for c in ("before", "after")))
        shown &= (day == "") | F.coalesce(settled & (F.col("array").isNull() | inside), F.lit(False))
    a, b, noise = F.col("before").try_cast("decimal(38,18)"), F.col("after").try_cast("decimal(38,18)"), pick([r.noise for r in table], "decimal(38,18)")
    kind = F.when(F.col("array").isNotNull(), MISSING).when(F.col("_rule").isNotNull() & pick([r.kind for r in table], "string").isNull(), None).when(F.col("before").isNull() | F.col("after").isNull(), MISSING)
    kind = kind.when((a >= 0) & (b >= 0) & (F.abs(a - b) <= noise), NUMERICAL).otherwise(pick([r.kind for r in table], "string"))
    names = [*stream, "account", "before_id", "after_id", "observed_us"]
    return g.where(shown).withColumn("kind", kind).where("kind is not null").select(*(F.col(f"pair.{c}").alias(c) for c in names), "kind", path.alias("field"), "before", "after")
