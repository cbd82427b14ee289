"""The registry of evidence references, units of parsed documents, and matrix products of vectors."""

import random

import numpy as np
import pytest

from docketry.operators import corpus, references, retrieval, search


def test_nested_paths(spark):
    tables = {
        "traces": spark.sql("select 1 as p, 't' as trace_id, array(named_struct('evidence_ids', array('a', 'x')), named_struct('evidence_ids', cast(null as array<string>)), null) as hits"),
        "comparisons": spark.sql("select 1 as p, 'c' as comparison_id, array('a', 'a') as evidence_ids, array(named_struct('evidence_ids', array('b', null))) as changes"),
        "facts": spark.sql("select * from values (1, 'f', array('a')), (2, 'f', array('a')), (2, 'g', null) as t(p, fact_id, evidence_ids)"),
    }
    evidence = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "p int, evidence_id string")
    got = sorted(map(tuple, references.dangling_references(tables, evidence, ["p"]).collect()), key=repr)
    want = [(1, "b", "change", "c"), (1, "x", "hit", "t"), (2, "a", "fact", "f"), (1, None, "change", "c")]
    assert got == sorted(want, key=repr)
    assert references.evidence_references(tables, ["p"]).where("kind = 'comparison'").count() == 1
    with pytest.raises(ValueError, match="none of the registry"):
        references.evidence_references({}, ["p"])


BLOCK = "k string, page int, n int, node boolean, block_type string, text string"


def units(spark, blocks, pages, **options):
    out = corpus.parsed_units(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(pages, "k string, page int, text string"), "k", options)
    return sorted(((r.k, r.unit, r.says, r.kind) for r in out.collect()), key=lambda u: u[:2])


def test_parsed_units(spark):
    blocks = [
        ("outline", 1, 1, True, "paragraph", " one "), ("outline", 1, 2, True, "table_cell", "cell"), ("outline", 1, 3, True, "paragraph", " "), ("outline", 1, 1, False, "paragraph", "not used"),
        ("pages", 1, 2, False, "paragraph", "second"), ("pages", 1, 1, False, "header", "first"), ("pages", 3, 1, False, "seal", "seal"), ("pages", 3, 2, False, None, "　last"),
    ]
    pages = [("outline", 2, "never"), ("pages", 1, "has blocks"), ("pages", 2, "a\r\n\n b c"), ("pages", 4, None), ("lines", 1, "x\x0by")]
    every = units(spark, blocks, pages)
    assert every == [
        ("lines", 0, "x", "paragraph"), ("lines", 1, "y", "paragraph"), ("outline", 0, "one", "paragraph"), ("outline", 1, "cell", "table_cell"), ("pages", 0, "first", "header"), ("pages", 1, "second", "paragraph"),
        ("pages", 2, "a", "paragraph"), ("pages", 3, "b", "paragraph"), ("pages", 4, "c", "paragraph"), ("pages", 5, "seal", "seal"), ("pages", 6, "last", None),
    ]
    fewer = units(spark, blocks, pages, ignore_tables=True, ignore_seals=True, ignore_header_footer=True, unheard_of=True)
    assert [x[2] for x in fewer if x[0] == "outline"] == ["one"] and [x[2] for x in fewer if x[0] == "pages"] == ["second", "a", "b", "c", "last"]
    assert units(spark, [], []) == []


def test_options(spark):
    assert corpus.compare_options({"ignore_seals": 1, "other": True}) == {n: n == "ignore_seals" for n in corpus.OPTIONS}
    df = spark.createDataFrame([("甲方：A-b_1，。",)], "t string")
    assert df.select(corpus.compared(df.t, {"ignore_symbols": True}), corpus.compared(df.t, {})).first()[:] == ("甲方Ab_1", "甲方：A-b_1，。")


@pytest.mark.parametrize("block", [20_000, 3])
def test_cosines(spark, block):
    rng = random.Random(1)
    rows = [(i, [float(rng.choice((-1, 0, 1, 2))) for _ in range(3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in retrieval.cosine_top_k(df, df.where("vec_id % 7 = 0 or vec_id = 61"), 4, block).collect():
        got.setdefault(r.query_id, []).append((r.vector_rank, r.doc_id, r.score))
    vec = {i: np.array(v or [0, 0, 0], dtype=float) for i, v in rows}

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(max(0.0, float(a @ b / n)) + 1e-9, 2) if n else 0.0

    for q in [i for i in vec if i % 7 == 0 or i == 61]:
        best = sorted(((-cosine(vec[q], vec[d]), d) for d in vec if d != q))[:4]
        assert sorted(got[q]) == [(k, d, -s) for k, (s, d) in enumerate(best, 1)]


def test_hybrid(spark):
    """The vector branch leaves out short chunks and low cosines, must pass the gate, and gives way where there are no vectors."""
    from tests.test_search import CHUNK, FILTER, QUERY, ask, chunk, limit

    query = ask("q", "付款条件", ["付款条件"], ["付款"]) | {"rule_id": "q", "embedding": [1.0, 0.0]}
    chunks = [
        chunk(1, 1, "付款条件：验收之后支付"), chunk(1, 2, "与付款相关的其他约定"), chunk(1, 3, "没有任何锚点的相似正文"), chunk(1, 4, "付款"), chunk(1, 5, "付款方面完全不相似的正文"),
        chunk(1, 9, "规则付款条件", "rule", rule_id="q"), chunk(2, 1, "付款条件：验收之后支付"),
    ]
    vectors = [(1, "c001", [1.0, 0.2]), (1, "c002", [1.0, 0.5]), (1, "c003", [1.0, 0.0]), (1, "c004", [1.0, 0.0]), (1, "c005", [0.05, 1.0]), (1, "c009", [0.0, 1.0])]
    c = spark.createDataFrame(chunks, CHUNK)
    q = spark.createDataFrame([query], QUERY + ", rule_id string, embedding array<double>")
    f = spark.createDataFrame([limit(1, "q"), limit(2, "q")], FILTER)
    v = spark.createDataFrame(vectors, "p int, chunk_id string, embedding array<double>")
    index = search.index_chunks(c, q, ["p"])
    near = {r.chunk_id: (r.vector_rank, r.score) for r in search.vector_search(index, v, q, f, ["p"], 9).collect()}
    assert near == {"c009": (1, 0.0), "c003": (2, 1.0), "c001": (3, 0.98), "c002": (4, 0.89)}  # c004 is short, c005 below the floor
    got = sorted((r.p, r.slot, r.chunk_id, r.lexical_rank is None, r.vector_rank is None, r.mode) for r in search.hybrid_search(index, v, q, f, ["p"], 3).collect())
    first = [g for g in got if g[0] == 1]
    assert [g[2] for g in first][0] == "c009" and "c003" not in {g[2] for g in first} and len(first) == 3 and {g[5] for g in first} == {"hybrid"}
    assert [(g[2], g[4], g[5]) for g in got if g[0] == 2] == [("c001", True, "lexical")]


def test_report_of_a_comparison(spark):
    from docketry.operators import compare

    pairs = spark.createDataFrame([(1, "a.docx", "b.docx", 0.945), (2, "c", "d", 1.0), (3, "e", "f", 0.494)], "pair_id long, base string, other string, similarity double")
    changes = spark.createDataFrame([(1, 1, "modified", "x", "y"), (1, 0, "deleted", "z", None), (3, 0, "added", "", "w"), (9, 0, "added", None, "no pair")], "pair_id long, pos int, kind string, before string, after string")
    said = {}
    for r in compare.report_lines(pairs, changes).orderBy("pair_id", "n").collect():
        said.setdefault(r.pair_id, []).append(r.line)
    assert "\n".join(said[1]) == "基准文档：a.docx\n比对文档：b.docx\n相似度：较为相似（94%）\n新增 0 处 / 删除 1 处 / 修改 1 处\n\n1. [删除]\n   基准：z\n2. [修改]\n   基准：x\n   比对：y"
    assert said[2][2:] == ["相似度：高度相似（100%）", "新增 0 处 / 删除 0 处 / 修改 0 处", "", "未发现差异。"]
    assert said[3][2] == "相似度：差异较大（49%）" and said[3][5:] == ["1. [新增]", "   比对：w"] and 9 not in said


def test_scope_that_meets_no_rule(spark):
    from docketry.operators import applicability

    rules = spark.createDataFrame([("r1", "finance"), ("r2", None)], "rule_id string, category string")
    contexts = spark.createDataFrame([(1, ["r1", "x"]), (2, ["finance"]), (3, []), (4, None), (5, ["x"]), (6, ["r2"])], "k int, review_scope array<string>")
    assert [tuple(r) for r in applicability.scope_issues(rules, contexts, "k").collect()] == [(5, "no rule in scope")]
