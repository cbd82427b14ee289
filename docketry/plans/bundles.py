"""Rule bundles written out of the parts as JSON, loaded, checked and merged. Forty parts make the libraries' base and extension."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.plans.base import query, table
from docketry.sources import bundles
from docketry.sources.shared import shared_folder

K = "p_partkey"
#: Holds in every other library; the rules of the others are fine.
EVEN = f"{K} % 80 < 40"
#: A rule of a part: what is wrong with it follows from the part's key.
RULE = f"""named_struct('rule_id', 'R' || {K}, 'version', '1', 'title', p_name, 'category', p_brand, 'applies_to', case when {EVEN} and {K} % 11 = 0 then array() else array('software') end,
  'applicability', case when {EVEN} and {K} % 11 = 0 then null when {EVEN} and {K} % 13 = 0 then map('other', named_struct('applicability', 'required')) when {K} % 2 = 0 then map('软件开发/转让服务', named_struct('applicability', 'required')) end,
  'check_method', 'deterministic', 'human_review', {EVEN} and {K} % 17 = 0, 'checker', case when {EVEN} and {K} % 19 = 0 then 'unheard_of' else 'tax_rate' end, 'expected_value', cast({K} % 7 as string))"""
LIBRARY = f"({K} // 40)"
#: Which parts make each layer of a library: (layer, condition, condition of the library).
LAYERS = [
    ("base", f"{K} % 2 = 0", "true"),
    ("extension", f"{K} % 2 = 1 or {K} % 40 = 0 and library % 5 = 0", "library % 3 <> 0"),
    ("published", f"{K} % 4 = 1", "library % 7 = 0"),
]


def written(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, DataFrame]:
    """The bundles of each layer, written as JSON lines and loaded again."""
    parts = table(spark, sf_dir, "part").selectExpr(f"floor({K} / 40) as library", K, f"{RULE} as rule")
    out = {}
    for layer, parts_of, libraries in LAYERS:
        by_key = lambda a, b: F.when(a[K] < b[K], -1).when(a[K] > b[K], 1).otherwise(0)
        ordered = F.array_sort(F.collect_list(F.struct(K, "rule")), by_key)  # forty parts at most
        rows = parts.where(f"({parts_of}) and ({libraries})").groupBy("library").agg(F.transform(ordered, lambda x: x["rule"]).alias("rules"))
        head = rows.selectExpr("cast(library as string) as library", f"'{layer}-' || library as bundle_id", f"sha2('{layer}' || library, 256) as source_sha256", "'validated' as release_status", "'2.0' as compatible_review_schema", "rules")
        head.write.json(f"{folder}/{layer}")
        out[layer] = bundles.load_bundles(spark, f"{folder}/{layer}", lines=True)
    return out


LAYER_SQL = " union all ".join(f"select *, '{layer}' as layer from p where ({parts_of}) and ({libraries})" for layer, parts_of, libraries in LAYERS)
USED = f"""p as (select {LIBRARY} as library, * from part), every as ({LAYER_SQL}),
used as (select * from every where (layer = 'published') = (library % 7 = 0 and exists (select 1 from every e where e.layer = 'published' and e.library = every.library))),
i as (
  select library, layer || '-' || library as bundle_id, 'R' || {K} as rule_id, issue from (
    select *, unnest([case when {EVEN} and {K} % 11 = 0 then 'no contract type' end, case when {EVEN} and {K} % 13 = 0 and {K} % 11 <> 0 then 'contract type without applicability' end,
      case when {EVEN} and {K} % 17 = 0 then 'deterministic under human review' end, case when {EVEN} and {K} % 19 = 0 then 'UNSUPPORTED_CHECKER' end]) as issue from used) where issue is not null
  union all select distinct library, null, 'R' || {K}, 'in base and extension' from used group by library, {K} having count(*) > 1)"""


@query(f"with {USED} select cast(library as varchar) as library, bundle_id, rule_id, issue from i")
def rule_bundle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against the bundles in force: rules without a type or its applicability, unknown checkers, ids in two layers."""
    layers = written(spark, sf_dir, f"{shared_folder(spark, 'bundles')}/bundles-{uuid.uuid4().hex}")
    return bundles.active_rules(layers["base"], layers["extension"], layers["published"])[1]


@query(
    f"""with {USED}, h as (select library, string_agg(distinct layer || '-' || library, '+' order by layer || '-' || library) as active_bundle,
  string_agg(distinct layer, ',' order by layer) as layers from used group by library)
select cast(library as varchar) as library, active_bundle, case when layers = 'base,extension' then sha256(sha256('base' || library) || chr(31) || sha256('extension' || library)) else sha256(layers || library) end as active_sha256,
  'R' || {K} as rule_id, cast({K} % 7 as varchar) as expected_value, cast(row_number() over (partition by library order by layer, {K}) as int) as place
from used join h using (library) where library not in (select library from i)"""
)
def rules_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of each library: base and extension merged, or what was published instead."""
    layers = written(spark, sf_dir, f"{shared_folder(spark, 'bundles')}/bundles-{uuid.uuid4().hex}")
    rules, _ = bundles.active_rules(layers["base"], layers["extension"], layers["published"])
    return rules.select("library", "active_bundle", "active_sha256", "rule_id", "expected_value", "place")
