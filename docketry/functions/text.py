"""Text expressions: tokens, stable ids, matches with offsets, money."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chinese digits and units, plain and financial forms.
DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "貳": 2, "两": 2, "三": 3, "叁": 3, "參": 3, "四": 4, "肆": 4,
          "五": 5, "伍": 5, "六": 6, "陆": 6, "陸": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
SECTIONS = {"万": 10_000, "亿": 100_000_000, "兆": 1_000_000_000_000}
NUMERAL = "".join([*DIGITS, *UNITS, *SECTIONS])
#: Full-width forms of the printable ASCII characters and the wide space, with what they stand for.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Detectors of personal and account data. Look-around leaves neighbours to the next match.
DETECTORS = {
    "mainland_id": r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])",
    "mainland_mobile": r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])",
    "email": r"(?U)(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])",
    "unified_social_credit_code": r"(?i)统一社会信用代码[^\n]{0,16}[：:]?\s*([0-9A-Z]{18})",
    "bank_account": r"(?:银行卡|银行账号|开户账号|账号|卡号)[^\n]{0,16}[：:]?\s*(?:[0-9][ -]?){12,24}[0-9]",
}


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value worked out once: inside lambdas Spark works out every use of an expression anew."""
    return F.transform(F.array(value), of)[0]


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words and numbers, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def grams(run: Column, n: int) -> Column:
    """Character n-grams of a run without spaces; none if it is shorter."""
    some = F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))
    return F.when(F.length(run) >= n, some).otherwise(F.array().cast("array<string>"))


def han_tokens(text: Column) -> Column:
    """Numbers, ASCII words and 2- and 3-grams of Han runs, repeats kept."""
    runs = F.regexp_extract_all(text, F.lit(r"[一-鿿]+"), F.lit(0))
    return F.concat(tokens(text), F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3)))))


#: Numbers, ASCII words with inner joints, and runs of Han characters.
TERM = r"[0-9][0-9,]*(?:\.[0-9]+)?%?|[a-z][a-z0-9]*(?:[._/-][a-z0-9]+)*|[一-鿿]+"
#: Figures with their units, and words that negate or limit.
NUMERIC_ANCHOR = r"[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:%|元|万元|日|天|工作日|月|年)?|[一二三四五六七八九十百千万零〇]+\s*(?:%|元|万元|日|天|工作日|月|年)"
NEGATIONS = ("不得", "不超过", "不低于", "不高于", "不能", "不应", "禁止", "除非", "未经", "无权", "仅限", "免除", "不承担")
HAN = "[一-鿿]+"


def plain(text: Column) -> Column:
    """Full-width forms narrowed and case folded; white space stays."""
    return F.lower(F.translate(text, WIDE, NARROW))


def _spread(run: Column, sizes: Sequence[int]) -> Column:
    return F.concat(*[grams(run, n) for n in sizes])


def terms(text: Column) -> Column:
    """Numbers (with commas also without), ASCII words, and 2- and 3-grams of Han runs of the folded text, repeats kept."""
    found = F.regexp_extract_all(plain(text), F.lit(TERM), F.lit(0))

    def one(t: Column) -> Column:
        bare = F.replace(t, F.lit(","), F.lit(""))
        number = F.when(bare == t, F.array(t)).otherwise(F.array(t, bare))
        return F.when(t.rlike("^[0-9]"), number).when(t.rlike("^[a-z]"), F.array(t)).otherwise(_spread(t, (2, 3)))

    return F.flatten(F.transform(found, one))


def query_phrases(text: Column) -> Column:
    """Distinct 4- to 6-grams of the Han runs, in the order of their runs and lengths."""
    runs = F.regexp_extract_all(plain(text), F.lit(HAN), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: _spread(r, (4, 5, 6)))))


def numeric_anchors(text: Column) -> Column:
    """Distinct figures with their units, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMERIC_ANCHOR), F.lit(0)), F.trim)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def negation_anchors(text: Column) -> Column:
    """The words of NEGATIONS that the text holds."""
    return F.filter(F.array(*map(F.lit, NEGATIONS)), lambda w: F.contains(text, w))


#: How a clause is numbered.
CLAUSE_NUMBERS = (
    r"^\s*第([一二三四五六七八九十百千万零〇0-9]+)条\s*[：:、.．-]?\s*",
    r"^\s*([0-9]+(?:\.[0-9]+){0,5})(?:\s*[、.．]\s*|\s+)",
    r"^\s*([一二三四五六七八九十百]+)\s*、\s*",
)


def one_line(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clause_number(text: Column) -> Column:
    """第N条, N.M or N of a numbered clause; NULL for other text."""
    line = one_line(text)
    first, *rest = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in CLAUSE_NUMBERS]
    return F.coalesce(F.concat(F.lit("第"), first, F.lit("条")), *rest)


def clause_title(text: Column) -> Column:
    """What follows the number up to the first full stop, semicolon or colon, 48 characters at most."""
    line = one_line(text)
    body = line
    for p in reversed(CLAUSE_NUMBERS):
        body = F.when(line.rlike(p), F.trim(F.regexp_replace(line, p, ""))).otherwise(body)
    source = F.when(body == "", line).otherwise(body)
    title = F.substring(F.trim(F.split(source, "[。；;：:]", 2)[0]), 1, 48)
    return F.when(title == "", "未命名条款").otherwise(title)


def plain_number(number: Column) -> Column:
    """3 for 第3条 and 3, so that both meet; other numberings compacted and case folded."""
    bare = F.regexp_replace(number, r"(?U)\s+", "")
    han = F.nullif(F.regexp_extract(bare, r"^第([一二三四五六七八九十百千万零〇0-9]+(?:\.[0-9]+)?)条$", 1), F.lit(""))
    return F.coalesce(han, F.lower(bare))


def is_heading(text: Column) -> Column:
    """A short line that begins with the number of a chapter, section or clause."""
    line = one_line(text)
    return (F.length(line) <= 80) & (line.rlike("^第[一二三四五六七八九十百千万零〇0-9]+[章节条款]") | line.rlike(r"^[0-9]+(?:\.[0-9]+)*[、. ]"))


def similarity_label(percent: Column) -> Column:
    """Band of a similarity in percent."""
    return F.when(percent >= 95, "identical").when(percent >= 80, "similar").when(percent >= 50, "partial").otherwise("different")


def stable_id(prefix: str, *parts: Column, size: int = 16) -> Column:
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, size))


def fold(text: Column) -> Column:
    """Full-width forms narrowed, case folded, without white space."""
    return compact(F.translate(text, WIDE, NARROW))


def compact(text: Column) -> Column:
    """Without any Unicode white space, case folded."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


#: A character that stands for a match while a text is cut; a text that holds it itself is cut by the pattern.
MATCH = "\x01"


def matches(text: Column, pattern: str) -> Column:
    """All matches as (start, end, says), code points from 0. The text is cut at its matches."""
    # split by a pattern compiles it for each row, replacing and finding don't; most texts hold no match and aren't cut
    gaps = F.when(F.contains(text, F.lit(MATCH)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, MATCH), MATCH, -1))
    parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("says"))
    kind = "array<struct<start:int,end:int,says:string>>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["says"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["says"].alias("says")))
        return F.struct(end.alias("at"), F.when(x["says"].isNull(), a["out"]).otherwise(F.concat(a["out"], one)).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)["out"]
    return F.when(~text.rlike(pattern), F.array().cast(kind)).otherwise(found)


def _lookup(c: Column, table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def numeral(text: Column) -> Column:
    """Value of a Chinese numeral, by (total, section, digit) over its characters; NULL if it holds any other character.

    A digit stands alone until a unit takes it up; 万, 亿 and 兆 take up the section before them.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("total", "section", "digit")])

    def step(a: Column, c: Column) -> Column:
        d, u, s = _lookup(c, DIGITS), _lookup(c, UNITS), _lookup(c, SECTIONS)
        held = a["section"] + a["digit"]
        return F.struct(
            F.when(s.isNotNull(), a["total"] + F.when(held == 0, 1).otherwise(held) * s).otherwise(a["total"]).cast("long").alias("total"),
            F.when(u.isNotNull(), a["section"] + F.when(a["digit"] == 0, 1).otherwise(a["digit"]) * u).when(s.isNotNull(), 0).otherwise(a["section"]).cast("long").alias("section"),
            F.when(d.isNotNull(), d).when(u.isNotNull() | s.isNotNull(), 0).otherwise(a["digit"]).cast("long").alias("digit"),
        )

    value = F.aggregate(F.split(text, ""), zero, step, lambda a: a["total"] + a["section"] + a["digit"])
    return F.when(text.rlike(f"^[{NUMERAL}]*$"), value)


def money(text: Column) -> Column:
    """DECIMAL(20,2) of an amount in Arabic digits (bare, or in 元, 万 or 万元) or Chinese numerals; NULL for anything else."""
    return let(F.regexp_replace(text, "人民币|[ ,，整]", ""), _bare_money)


def _bare_money(bare: Column) -> Column:
    arabic = F.nullif(F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)?)(?:万元?|元)?$", 1), F.lit(""))
    scaled = lambda a: F.round(a.try_cast("decimal(28,8)") * F.when(F.contains(bare, F.lit("万")), 10_000).otherwise(1), 2).try_cast("decimal(20,2)")
    yuan = F.regexp_replace(bare, "圆", "元")
    whole, rest = F.split(yuan, "元", 2)[0], F.coalesce(F.get(F.split(yuan, "元", 2), F.lit(1)), F.lit(""))
    part = lambda unit, size: F.coalesce(_lookup(F.regexp_extract(rest, f"^[^{unit}]*(.){unit}", 1), DIGITS), F.lit(0)) * size
    spelled = let(whole, numeral).cast("decimal(20,2)") + ((part("角", 10) + part("分", 1)) / 100).cast("decimal(4,2)")
    return let(arabic, lambda a: F.when(a.isNotNull(), scaled(a)).when((bare != "") & (yuan != "元"), spelled.try_cast("decimal(20,2)")))
