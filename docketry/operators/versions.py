"""What a new version of a contract changes: liability caps, directions of risk, clauses and rules touched, attachments to runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import DIGITS, SECTIONS, UNITS, matches, money, numeral, stable_id
from docketry.operators.phrases import containing

#: Words by which a sentence speaks of a liability cap, and words that mark its value.
CAP_LABELS = ("赔偿责任上限", "违约责任上限", "责任上限", "累计赔偿责任", "累计赔偿金额", "赔偿责任", "违约责任", "赔偿金额")
CAP_MARKERS = ("不超过", "不高于", "最高", "责任上限", "赔偿责任上限", "违约责任上限", "为限", "限于", "作为")
_HAN = "".join([*DIGITS, *UNITS, *SECTIONS])
CAP_VALUE = rf"[0-9]+(?:\.[0-9]+)?\s*[％%]|百分之[{_HAN}]+|(?:[0-9][0-9,，]*(?:\.[0-9]+)?\s*(?:万元?|元)|[{_HAN}]+[元圆])"
#: Sentences that raise a risk, and words that tie payment to delivery and acceptance.
PREPAID = r"(?:100\s*%|百分之百|一次性全额)\s*(?:预付|支付)"
EXEMPT = "不承担(?:任何)?(?:违约)?责任|全面免责|免责"
BOUND = ("交付", "验收", "付款|支付|结算")
#: Words by which a change concerns a checker's rules.
MARKERS = {
    "payment_terms": ("付款", "支付", "预付款", "首付款", "尾款", "结算", "价款", "合同金额", "合同总价", "发票"),
    "delivery_terms": ("交付", "交货", "到货", "工期", "履行期限"),
    "acceptance_terms": ("验收", "验收标准", "验收方法", "不合格"),
    "renewal_terms": ("续期", "续签", "自动续期", "自动续签"),
    "termination_terms": ("解除", "终止", "解约", "提前解除"),
    "breach_liability_terms": ("违约", "违约责任", "违约金", "赔偿", "责任上限", "免责", "损失", "质保", "保修", "保证", "支持", "维护"),
    "cross_document_consistency": ("合同", "协议", "附件", "报价单", "订单", "优先", "冲突"),
}
_CAP = "struct<kind:string,value:decimal(26,8)>"


def _holds(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words))


def cap_value(said: Column) -> Column:
    """(kind, value) of one literal: a ratio from % or 百分之, else an amount; NULL if it can't be read."""
    spelt = F.regexp_extract(said, f"百分之([{_HAN}]+)", 1)
    share = F.when(spelt != "", numeral(spelt).cast("decimal(26,8)")).otherwise(F.regexp_extract(said, r"([0-9.]+)\s*[％%]", 1).try_cast("decimal(26,8)")) / 100
    amount = money(F.concat(F.regexp_replace(F.regexp_replace(said, "，", ","), "[元圆]$", ""), F.lit("元"))).cast("decimal(26,8)")
    ratio = said.rlike("[％%]|百分之")
    kind = F.when(ratio, "ratio").otherwise("amount")
    value = F.when(ratio, share.cast("decimal(26,8)")).otherwise(amount)
    return F.when(value.isNotNull(), F.struct(kind.alias("kind"), value.alias("value")))


def cap_candidates(text: Column) -> Column:
    """One entry for each sentence about a cap that states a value; its `cap` is NULL where the sentence leaves it open.

    A sentence with one value right behind a marker (48 characters) means that one, else its only value.
    """

    def read(sentence: Column) -> Column:
        def one(m: Column) -> Column:
            at = F.greatest(m["start"] - 48, F.lit(0))
            before = F.substring(sentence, at + 1, m["start"] - at)
            return F.struct(cap_value(m["says"]).alias("cap"), _holds(before, CAP_MARKERS).alias("marked"))

        values = F.filter(F.transform(matches(sentence, CAP_VALUE), one), lambda v: v["cap"].isNotNull())
        marked = F.filter(values, lambda v: v["marked"])
        cap = F.when(F.size(marked) == 1, F.get(marked, F.lit(0))["cap"]).when(F.size(values) == 1, F.get(values, F.lit(0))["cap"])
        return F.struct((F.size(values) > 0).alias("stated"), cap.alias("cap"))

    about = F.filter(F.split(F.coalesce(text, F.lit("")), "[。；;\n]"), lambda s: _holds(s, CAP_LABELS))
    return F.transform(F.filter(F.transform(about, read), lambda r: r["stated"]), lambda r: r["cap"])


def liability_cap(text: Column) -> Column:
    """The one cap (kind, value) that a text states; NULL if there is none, several, or a sentence that leaves it open."""
    caps = F.array_distinct(cap_candidates(text))
    return F.when((F.size(caps) == 1), F.get(caps, F.lit(0)))


def turned(before: Column, after: Column) -> Column:
    """Direction of a risk that a text has or hasn't."""
    return F.when(after & ~before, "increased").when(before & ~after, "decreased").otherwise("requires_review")


def cap_direction(before: Column, after: Column) -> Column:
    """A new cap narrows liability, a dropped or higher one widens it; other kinds of value can't be compared."""
    return (
        F.when(before.isNull() & after.isNull(), "requires_review")
        .when(before.isNull(), "decreased")
        .when(after.isNull(), "increased")
        .when(before["kind"] != after["kind"], "requires_review")
        .when(after["value"] > before["value"], "increased")
        .when(after["value"] < before["value"], "decreased")
        .otherwise("unchanged")
    )


def comparison_records(pairs: DataFrame, package: str) -> DataFrame:
    """Add comparison_id from the package and the hashes of both texts (base_sha256, compare_sha256)."""
    return pairs.withColumn("comparison_id", stable_id("cmp-", F.col(package), F.col("base_sha256"), F.col("compare_sha256"), size=20))


def precedence(base: Column, compare: Column, order: Column, same: Column) -> Column:
    """Which of two documents prevails by the package's order; unresolved unless both are in it."""
    a, b = F.array_position(order, base), F.array_position(order, compare)
    return F.when(same, "not_required").when((F.coalesce(a, F.lit(0)) == 0) | (F.coalesce(b, F.lit(0)) == 0), "unresolved").when(a < b, "base").otherwise("compare")


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def changed_clauses(changes: DataFrame, clauses: DataFrame) -> DataFrame:
    """change_id, clause_id: the clauses of the base or the new document that hold a change's text of that side.

    changes: change_id, base_sha256, compare_sha256, before, after. clauses: clause_id, source_sha256, text.
    White space doesn't count. The texts meet by their first characters within a document, not all with all.
    """
    sides = [("base_sha256", "before"), ("compare_sha256", "after")]
    said = [changes.select("change_id", F.col(sha).alias("source_sha256"), single_spaced(F.col(text)).alias("_said")) for sha, text in sides]
    held = clauses.select("clause_id", "source_sha256", single_spaced(F.col("text")).alias("_clause"))
    found = containing(held, ["clause_id", "source_sha256"], "_clause", said[0].union(said[1]).distinct(), "_said", ["source_sha256"], size=8)
    return found.select("change_id", "clause_id").distinct()


def affected_rules(changes: DataFrame, bound: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """change_id, rule_id, link: by a finding on a clause of the change; without one, by a marker of a rule inside its text;
    without that, unmapped with a null rule, which asks for all rules again.

    changes: change_id, before, after. bound: change_id, clause_id. findings: rule_id, clause_id. rules: rule_id, marker.
    """
    by_clause = bound.join(findings.select("rule_id", "clause_id").distinct(), "clause_id").select("change_id", "rule_id").distinct()
    texts = changes.select("change_id", F.concat_ws("\n", F.trim("before"), F.trim("after")).alias("_text"))
    free = texts.join(by_clause.select("change_id").distinct(), "change_id", "left_anti")
    by_marker = containing(free, ["change_id"], "_text", rules.select("rule_id", "marker").distinct(), "marker").select("change_id", "rule_id").distinct()
    mapped = by_clause.withColumn("link", F.lit("clause")).union(by_marker.withColumn("link", F.lit("marker")))
    return changes.select("change_id").distinct().join(mapped, "change_id", "left").withColumn("link", F.coalesce("link", F.lit("unmapped")))


def rule_markers(rules: DataFrame) -> DataFrame:
    """rule_id, marker from rules (rule_id, checker, title, category, condition) and the fixed words of their checker."""
    fixed = F.create_map(*[x for c, words in MARKERS.items() for x in (F.lit(c), F.array(*map(F.lit, words)))])
    own = F.array("title", "category", "condition")
    marker = F.explode(F.array_distinct(F.concat(own, F.coalesce(fixed[F.col("checker")], F.array().cast("array<string>")))))
    return rules.select("rule_id", marker.alias("marker")).where(F.length("marker") > 0)


def impacts(changes: DataFrame, links: DataFrame, checkers: DataFrame) -> DataFrame:
    """comparison_id, rule_id, n_changes, payment, liability, cap, delivery: one row for each rule that a comparison touches.

    changes: comparison_id, change_id, before, after. links: change_id, rule_id. checkers: rule_id, checker.
    Texts are reduced to flags and caps before they are grouped, so no group's texts come together. A direction is
    `unknown` where the rule's checker doesn't look at it and `requires_review` where there is no checker.
    """
    both = changes.select(
        "comparison_id",
        "change_id",
        *[F.coalesce(F.col(s), F.lit("")).rlike(p).alias(f"{n}_{s}") for s in ("before", "after") for n, p in _FLAGS.items()],
        *[cap_candidates(F.col(s)).alias(f"caps_{s}") for s in ("before", "after")],
    )
    rows = both.join(links.select("change_id", "rule_id").distinct(), "change_id").join(checkers.select("rule_id", "checker").distinct(), "rule_id", "left")
    flags = [F.max(f"{n}_{s}").alias(f"{n}_{s}") for s in ("before", "after") for n in _FLAGS]
    grouped = rows.groupBy("comparison_id", "rule_id", "checker").agg(F.count_distinct("change_id").alias("n_changes"), *flags, *[e for s in ("before", "after") for e in _cap_parts(s)])
    caps = [F.when((F.col(f"open_{s}") == 0) & F.col(f"least_{s}").eqNullSafe(F.col(f"most_{s}")), F.col(f"least_{s}")) for s in ("before", "after")]
    bound = [F.col(f"given_{s}") & F.col(f"met_{s}") & F.col(f"paid_{s}") for s in ("before", "after")]
    cap = cap_direction(*caps)
    payment, exempt = turned(F.col("prepaid_before"), F.col("prepaid_after")), turned(F.col("exempt_before"), F.col("exempt_after"))
    liability = F.when(exempt != "requires_review", exempt).when(cap.isin("increased", "decreased"), cap).otherwise("requires_review")
    only = lambda on, value: F.when(F.col("checker").isNull(), "requires_review").when(F.col("checker").isin(*on), value).otherwise("unknown")
    return grouped.select(
        "comparison_id",
        "rule_id",
        "n_changes",
        only(["payment_terms"], payment).alias("payment"),
        only(["breach_liability_terms"], liability).alias("liability"),
        only(["breach_liability_terms"], cap).alias("cap"),
        only(["delivery_terms", "acceptance_terms"], turned(bound[1], bound[0])).alias("delivery"),
    )


_FLAGS = {"prepaid": PREPAID, "exempt": EXEMPT, "given": BOUND[0], "met": BOUND[1], "paid": BOUND[2]}


def _cap_parts(side: str) -> list[Column]:
    caps = F.col(f"caps_{side}")
    known = F.array_sort(F.filter(caps, lambda c: c.isNotNull()))
    return [
        F.sum(F.size(F.filter(caps, lambda c: c.isNull()))).alias(f"open_{side}"),
        F.min(F.get(known, F.lit(0))).alias(f"least_{side}"),
        F.max(F.get(known, F.size(known) - 1)).alias(f"most_{side}"),
    ]


def retriggered(touched: DataFrame, active: DataFrame) -> DataFrame:
    """comparison_id, rule_id: rules to run again; a comparison with an unmapped change (null rule) runs all active ones.

    active: package rules as (comparison_id, rule_id).
    """
    open_ones = touched.where("rule_id is null").select("comparison_id").distinct()
    named = touched.where("rule_id is not null").select("comparison_id", "rule_id")
    return named.union(active.select("comparison_id", "rule_id").join(open_ones, "comparison_id", "left_semi")).distinct()


def affected_obligations(links: DataFrame, bound: DataFrame, duties: DataFrame) -> DataFrame:
    """rule_id, clause_id, summary: obligations (clause_id, subject, modality, action) of the clauses whose change touches a rule."""
    who = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("合同当事人"))
    verb = F.when(F.col("modality") == "required", "必须").otherwise("不得")
    told = duties.select("clause_id", F.substring(F.concat(who, verb, F.col("action")), 1, 240).alias("summary")).distinct()
    return links.where("rule_id is not null").join(bound, "change_id").select("rule_id", "clause_id").distinct().join(told, "clause_id")


def comparison_issues(comparisons: DataFrame, documents: DataFrame, package: str) -> DataFrame:
    """comparison_id, issue of comparisons (package, comparison_id, base_sha256, base_name, n_changes, n_evidence) that can't be attached.

    documents: package, source_sha256, filename.
    """
    base = documents.groupBy(package, F.col("source_sha256").alias("base_sha256")).agg(F.collect_set("filename").alias("_names"))
    n = comparisons.groupBy(package, "comparison_id").agg(F.count("*").alias("_n"))
    both = comparisons.join(base, [package, "base_sha256"], "left").join(n, [package, "comparison_id"])
    issue = (
        F.when(F.col("_n") > 1, "repeated id")
        .when(F.col("_names").isNull(), "base not in package")
        .when(~F.array_contains("_names", F.col("base_name")), "other name")
        .when((F.col("n_changes") > 0) & (F.col("n_evidence") < F.col("n_changes")), "change without evidence")
    )
    return both.select(package, "comparison_id", issue.alias("issue")).where("issue is not null").distinct()


def revision_issues(sets: DataFrame, results: DataFrame, run: str) -> DataFrame:
    """set_id, issue of revision sets (run, set_id, base_fingerprint) that don't belong to a result (run, fingerprint)."""
    n = sets.groupBy(run, "set_id").agg(F.count("*").alias("_n"))
    both = sets.join(n, [run, "set_id"]).join(results.select(run, "fingerprint"), run, "left")
    issue = F.when(F.col("fingerprint").isNull(), "no such run").when(F.col("fingerprint") != F.col("base_fingerprint"), "other base").when(F.col("_n") > 1, "repeated id")
    return both.select(run, "set_id", issue.alias("issue")).where("issue is not null").distinct()
