"""Class-parser binding.

A parser applies to a class when (typed form only) its result type is one the
class accepts (C1) and any of its sample URLs passes that class's rules (C2;
C3 drops the type test).  This is an existential test over two rule tables:
the sample URLs are a one-column DataFrame, each class contributes one
boolean Column (the compiled rules, see ``classify.apply_class``), and
``stack`` turns the flags into (class, parser) rows - a projection and a
``distinct``, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.classify import apply_class
from webloom.sources.rules import CLASS_PARSER_TYPES, Parser, RuleError, URLClass


_BOUND: dict[str, list] = {}


def binding(spark: SparkSession, classes: list[URLClass], parsers: list[Parser],
            typed: bool = True, strict: bool = False) -> DataFrame:
    """Rows (uclass, class_type, parser, parser_type, parser_ordinal)."""
    samples = [(p.name, p.type, p.ordinal, u) for p in parsers for u in p.urls]
    schema = "parser string, parser_type string, parser_ordinal int, sample_url string"
    df = spark.createDataFrame(samples, schema)
    df = df.withColumn("_u", U.split_url(F.col("sample_url")))
    # C4: a sample URL that does not parse is skipped, or fails the call.
    if strict:
        bad = df.where(~F.col("_u")["valid"]).select("parser", "sample_url").first()
        if bad:
            raise RuleError(f"parser {bad['parser']!r}: bad sample URL {bad['sample_url']!r}")
    df = df.where(F.col("_u")["valid"])
    flags = []
    for c in classes:
        allowed = CLASS_PARSER_TYPES.get(c.cls, ())
        ok = apply_class(c, F.col("_u"), only_match=True)["matched"]
        if typed:
            ok = ok & F.col("parser_type").isin(*allowed) if allowed else F.lit(False)
        flags.append((c, ok))
    if not flags:
        return spark.createDataFrame([], "uclass string, class_type string, parser string, parser_type string, parser_ordinal int")
    stack_args = ", ".join(f"'{c.name}', '{c.cls}', `_f{i}`" for i, (c, _) in enumerate(flags))
    wide = df.select("parser", "parser_type", "parser_ordinal",
                     *[ok.alias(f"_f{i}") for i, (_, ok) in enumerate(flags)])
    long = wide.selectExpr("parser", "parser_type", "parser_ordinal",
                           f"stack({len(flags)}, {stack_args}) as (uclass, class_type, ok)")
    return (long.where("ok").select("uclass", "class_type", "parser", "parser_type", "parser_ordinal")
            .distinct())


def binding_map(spark: SparkSession, classes, parsers, typed=True) -> dict[str, list[Parser]]:
    """The binding as a driver-side dict class -> parsers in rule order.  Its
    size is bounded by (#classes x #parsers) of the rule set, never by data.
    It depends on the rules alone and is worked out once for each rule set."""
    known = repr((classes, parsers, typed))
    if known not in _BOUND:
        _BOUND[known] = binding(spark, classes, parsers, typed).collect()
    rows = _BOUND[known]
    by_name = {p.name: p for p in parsers}
    out: dict[str, list[Parser]] = {}
    for r in rows:
        out.setdefault(r.uclass, []).append(by_name[r.parser])
    for k in out:
        out[k].sort(key=lambda p: p.ordinal)
    return out
