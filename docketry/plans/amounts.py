"""Ways in which contracts state amounts, drawn for each order, and the facts read from them.

FORMS holds a sentence and what must be read from it, (kind, value, what stands right before the value), as SQL over the
columns of `orders`: the sentences are the same text for both engines, the facts are known from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import facts
from docketry.plans.base import query, table

K, T = "o_orderkey", "cast(cast(o_totalprice as decimal(20,2)) as string)"
D, N = f"substr('壹贰叁肆伍陆柒捌玖', cast({K} % 9 + 1 as int), 1)", f"({K} % 9 + 1)"
text = lambda x: f"cast({x} as string)"
#: (in a table, sentence, facts).
FORMS = [
    (False, f"'合同总价：人民币' || {T} || '元整'", [("amount", "o_totalprice", "'合同总价：'")]),
    (False, f"'合同价款：' || {text(f'{K} % 900 + 100')} || '，000。'", [("amount", f"({K} % 900 + 100) * 1000", "'合同价款：'")]),
    (False, f"'含税金额 ' || {text(f'{K} % 97 + 3')} || '万'", [("amount", f"({K} % 97 + 3) * 10000", "'含税金额 '")]),
    (False, f"'合同金额：' || {D} || '佰万元整'", [("upper", f"{N} * 1000000", "'合同金额：'")]),
    (False, f"'合同总额' || {D} || '兆元'", [("upper", f"{N} * 1000000000000", "'合同总额'")]),
    (True, f"'小计：' || {T}", [("detail_total", "o_totalprice", "'小计：'")]),
    (True, f"'数量 | 金额：' || {T} || '元'", [("detail", "o_totalprice", "'数量 | 金额：'")]),
    (False, f"'金额：' || {T} || '；合计 7'", []),
    (False, f"'开具' || {text(f'{K} % 17 + 1')} || '%专用发票'", [("rate", f"({K} % 17 + 1) / 100.0", "'开具'")]),
    (False, f"'付款 ' || {text(f'{K} % 90 + 10')} || '％，余款两清'", [("ratio", f"({K} % 90 + 10) / 100.0", "'付款 '")]),
    (False, f"'违约金为合同价的' || {text(f'{K} % 9 + 1')} || '%，甲方付款后生效'", []),
    (False, f"'合同价款（小写：' || {T} || '元，大写：' || {D} || '拾万元）'", [("amount", "o_totalprice", "'合同价款（小写：'"), ("upper", f"{N} * 100000", f"'合同价款（小写：' || {T} || '元，大写：'")]),
    (False, f"'不含税金额：' || {T} || '元；税款' || {D} || '元伍角'", [("base", "o_totalprice", "'不含税金额：'"), ("tax", f"{N} + 0.5", f"'不含税金额：' || {T} || '元；税款'")]),
    (False, f"'价税合计：' || {T} || '元，支付总额' || {T}", [("invoice", "o_totalprice", "'价税合计：'"), ("payment", "o_totalprice", f"'价税合计：' || {T} || '元，支付总额'")]),
]
FORM = f"{K} % {len(FORMS)}"


@query(
    " union all ".join(
        f"select {K} as package_id, '{kind}' as kind, cast({value} as double) as value, length({before})::int as begins from orders where {FORM} = {i}"
        for i, (_, _, found) in enumerate(FORMS)
        for kind, value, before in found
    )
)
def stated_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, rates and shares of each order's sentence: bare, with commas, in 万 and 兆, spelled out, in cells."""
    sentence = f"case {' '.join(f'when {FORM} = {i} then {said}' for i, (_, said, _) in enumerate(FORMS))} end as says"
    rows = table(spark, sf_dir, "orders").selectExpr(f"{K} as package_id", sentence, f"{FORM} in ({', '.join(str(i) for i, form in enumerate(FORMS) if form[0])}) as cell")
    return facts.financial_facts(rows, "package_id", "says", F.col("cell")).select("package_id", "kind", F.col("value").cast("double").alias("value"), "begins")
