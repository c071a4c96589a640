"""Evaluation arithmetic: guarded precision and recall, Wilson bounds, composite scores, votes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b in doubles; ``empty`` (a number or null) where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty).cast("double"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def precision_recall(tp: Column, fp: Column, fn: Column, empty: float | None = 0.0) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    return {"precision": p, "recall": r, "f1": f1(p, r) if empty is not None else F.when(p.isNotNull() & r.isNotNull(), f1(p, r))}


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the 95 % Wilson interval; 0 for no trials."""
    n, p = n.cast("double"), ratio(hits, n)
    z2 = z * z
    centre = p + F.lit(z2) / (F.lit(2.0) * n)
    spread = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + F.lit(z2) / (F.lit(4.0) * n)) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / (F.lit(1.0) + F.lit(z2) / n))).otherwise(F.lit(0.0))


def share_found(expected: Column, found: Column) -> Column:
    """Different expected members that were found, over the length of the expected list; 1 for an empty list."""
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(expected, found)).cast("double") / F.size(expected))


def composite(parses: Column, schema: Column, conditions: Column, labs: Column, drugs: Column) -> Column:
    """.20 for output that parses, .20 of the schema share, .30 conditions, .15 labs, .15 drugs."""
    return F.when(parses, 0.20).otherwise(0.0) + 0.20 * schema + 0.30 * conditions + 0.15 * labs + 0.15 * drugs


def majority(votes: DataFrame, case: str, run: str, value: list[str]) -> DataFrame:
    """Values that at least half plus one of a case's runs hold, counting every occurrence; adds votes and runs."""
    runs = votes.groupBy(case).agg(F.countDistinct(run).alias("runs"))
    counted = votes.groupBy(case, *value).agg(F.count("*").alias("votes"))
    return counted.join(runs, case).where(F.col("votes") >= F.floor(F.col("runs") / 2) + 1)


# --- scoring variants of an extraction against its case ----------

#: Code systems of an item, lists of a record that hold items, and the sections of a complete record.
SYSTEMS = ("snomed", "icd10", "loinc", "rxnorm")
CODED = ("conditions", "labs", "meds")
SECTIONS = ("patient", "conditions", "labs", "meds", "vitals")


def _list(codes: Column) -> Column:
    return F.coalesce(codes.cast("array<string>"), F.array().cast("array<string>"))


def flat_score(expected: dict[str, Column], got: dict[str, Column]) -> dict[str, Column]:
    """V2: matched, expected and fp counts over all buckets together; a code found in another bucket counts as found. Codes of a bucket are stripped, and each counts once."""
    tidy = lambda c: F.array_distinct(F.filter(F.transform(_list(c), lambda x: F.trim(x)), lambda x: x != ""))
    want, have = (F.concat(*[tidy(c) for c in side.values()]) for side in (expected, got))
    return {
        "matched": F.size(F.filter(want, lambda x: F.array_contains(have, x))),
        "expected": F.size(want),
        "fp": F.size(F.filter(have, lambda x: ~F.array_contains(want, x))),
    }


def _named(bucket: str, codes: Column) -> Column:
    return F.transform(codes, lambda x: F.concat(F.lit(f"{bucket}:"), x))


def bucket_score(expected: dict[str, Column], got: dict[str, Column]) -> dict[str, Column]:
    """V3: lists matched, missing and spurious of ``bucket:code`` by sets, and ``perfect``: as many matched as the expected lists are long, and none spurious."""
    out: dict[str, list[Column]] = {"matched": [], "missing": [], "spurious": []}
    length = F.lit(0)
    for bucket, codes in expected.items():
        want, have = _list(codes), _list(got[bucket])
        length = length + F.size(want)
        for name, c in (("matched", F.array_intersect(have, want)), ("missing", F.array_except(want, have)), ("spurious", F.array_except(have, want))):
            out[name].append(_named(bucket, c))
    joined = {name: F.array_sort(F.concat(*parts)) for name, parts in out.items()}
    return {**joined, "perfect": (F.size(joined["matched"]) == length) & (F.size(joined["spurious"]) == 0)}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def record_codes(record: Column) -> Column:
    """V4: the different ``system|code`` of a record (a variant): codes of its items, and ``vital|name`` for each vital sign that has a value. Parts of another shape hold none."""
    texts = lambda v, path: F.try_variant_get(v, path, "map<string,string>")
    none = F.array().cast("array<string>")
    listed = [F.coalesce(F.try_variant_get(record, f"$.{part}", "array<variant>"), F.array().cast("array<variant>")) for part in CODED]
    held = lambda m, kept: F.map_entries(F.map_filter(m, kept))
    coded = F.transform(F.concat(*listed), lambda item: F.transform(held(texts(item, "$"), lambda k, v: k.isin(*SYSTEMS) & (v != "")), lambda e: F.concat(e["key"], F.lit("|"), e["value"])))
    vitals = F.transform(held(texts(record, "$.vitals"), lambda _, v: v.isNotNull() & (v != "")), lambda e: F.concat(F.lit("vital|"), e["key"]))
    return F.array_distinct(F.concat(F.flatten(F.filter(coded, lambda c: c.isNotNull())), F.coalesce(vitals, none)))


def record_scored(gold_text: Column, pred_text: Column) -> Column:
    """V4: struct of tp, fp, fn over the codes of two records given as JSON text, json_valid, schema_complete (all sections there). Text that is no JSON has no codes. Each text is made and parsed once a row."""
    none = F.array().cast("array<string>")
    codes = lambda record: F.coalesce(record_codes(record), none)

    def parsed(pred: Column) -> Column:
        sections = F.map_keys(F.try_variant_get(pred, "$", "map<string,variant>"))
        complete = F.coalesce(F.size(F.array_intersect(sections, F.array(*map(F.lit, SECTIONS)))) == len(SECTIONS), F.lit(False))
        return F.struct(codes(pred).alias("have"), pred.isNotNull().alias("json_valid"), complete.alias("schema_complete"))

    def counted(both: Column) -> Column:
        want, have = both["want"], both["pred"]["have"]
        return F.struct(
            F.size(F.array_intersect(want, have)).alias("tp"), F.size(F.array_except(have, want)).alias("fp"), F.size(F.array_except(want, have)).alias("fn"),
            both["pred"]["json_valid"].alias("json_valid"), both["pred"]["schema_complete"].alias("schema_complete"),
        )

    return _once(F.struct(_once(F.try_parse_json(gold_text), codes).alias("want"), _once(F.try_parse_json(pred_text), parsed).alias("pred")), counted)


def record_score(gold_text: Column, pred_text: Column) -> dict[str, Column]:
    """The fields of ``record_scored``; over many rows, select the struct once and open it behind."""
    scored = record_scored(gold_text, pred_text)
    return {k: scored[k] for k in ("tp", "fp", "fn", "json_valid", "schema_complete")}


def verbatim_score(expected: dict[str, Column], text: Column) -> dict[str, Column]:
    """V5: codes of each bucket that stand anywhere in the text, their number, and the share found (0 for nothing expected)."""
    held = {f"matched_{b}": F.filter(_list(c), lambda x: F.coalesce(text, F.lit("")).contains(x)) for b, c in expected.items()}
    total = sum((F.size(_list(c)) for c in expected.values()), F.lit(0))
    found = sum((F.size(c) for c in held.values()), F.lit(0))
    return {**held, "total_expected": total, "total_matched": found, "extraction_score": ratio(found, total)}


def summary(cases: DataFrame, group: list[str]) -> DataFrame:
    """Micro and macro precision, recall and F1 of cases with tp, fp, fn, json_valid and schema_complete, and the rates of the last two, by group."""
    per_case = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    rows = cases.select("*", *[c.alias(f"case_{k}") for k, c in per_case.items()])
    sums = rows.groupBy(*group).agg(
        F.count("*").alias("n"), *[F.sum(k).alias(k) for k in ("tp", "fp", "fn")], *[F.round(F.avg(f"case_{k}"), 4).alias(f"macro_{k}") for k in per_case],
        *[F.round(F.avg(F.col(k).cast("int")), 4).alias(f"{k}_rate") for k in ("json_valid", "schema_complete")],
    )
    return sums.select("*", *[F.round(c, 4).alias(f"micro_{k}") for k, c in precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def sweep(cases: DataFrame, group: list[str]) -> DataFrame:
    """V6: totals of cases with matched, expected, fp and error by group; cases with an error count as errors alone, and a case without expected codes isn't perfect."""
    ok = F.col("error").isNull()
    of = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0))
    perfect = ok & (F.col("expected") > 0) & (F.col("matched") == F.col("expected")) & (F.col("fp") == 0)
    sums = cases.groupBy(*group).agg(
        F.count_if(ok).alias("n_cases"), F.count_if(~ok).alias("errors"), F.count_if(perfect).alias("perfect"), of("matched").alias("matched"), of("expected").alias("expected"), of("fp").alias("false_positives")
    )
    p, r = ratio(F.col("matched"), F.col("matched") + F.col("false_positives")), ratio(F.col("matched"), F.col("expected"))
    return sums.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"))
