"""Literal cases of the functions that must give given results: questions, personal data, orphans, profiles, accents, complexity."""

import re

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import numbers, pii, query_text, text
from lakeloom.operators import chunking, structured


def values(spark, f, items):
    df = spark.createDataFrame(list(enumerate(items)), "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_price_ranges(spark):
    cases = {
        "dưới 2tr có bao nhiêu dịch vụ": (None, 2_000_000, "count"),
        "liệt kê dịch vụ dưới 500k": (None, 500_000, "list"),
        "dưới 2tr": (None, 2_000_000, "filter"),
        "trên 500k": (500_000, None, "filter"),
        "từ 500k đến 2tr": (500_000, 2_000_000, "list"),
        "từ 2tr đến 500k": (500_000, 2_000_000, "list"),
        "khoảng 1 triệu": (900_000, 1_100_000, "list"),
        "dịch vụ nào dưới 800 nghìn": (None, 800_000, "filter"),
        "combo trên 1 triệu có gì": (1_000_000, None, "filter"),
        "dịch vụ nào đắt nhất": (None, None, "max"),
        "dịch vụ rẻ nhất là gì": (None, None, "min"),
        "giá cao nhất bao nhiêu": (None, None, "max"),
        "which service is the cheapest": (None, None, "min"),
        "the most expensive package": (None, None, "max"),
        "dưới này kia nọ": None,
        "Thông tư 18/2018 thay thế gì?": None,
        "Điều 9 quy định gì": None,
        "xin chào bạn khỏe không": None,
        "sản phẩm nào tốt nhất": None,
        "": None,
        "   ": None,
        None: None,
    }
    got = values(spark, query_text.price_range, list(cases))
    assert [r and (r.price_min, r.price_max, r.operation) for r in got] == list(cases.values())
    assert all(r is None or r.confidence >= 0.75 for r in got)


def test_lists_codes_prices_and_summaries(spark):
    listed = values(spark, query_text.list_of, ["liệt kê dịch vụ tẩy da chết", "tư vấn về da", "có bao nhiêu dịch vụ massage", "giá bao nhiêu", "sau bao nhiêu ngày giám định", "xin chào", None])
    assert [r and (r.operation, r.keyword) for r in listed] == [("keyword", "tẩy da chết"), ("keyword", "da"), ("count", "massage"), None, None, None, None]
    prices = values(spark, query_text.price_of, ["tẩy da chết giá bao nhiêu", "Điều 5 giá bao nhiêu", "massage dưới 500k giá bao nhiêu", "how much", "da đẹp", None])
    assert [r and r.keyword for r in prices] == ["tẩy da chết", None, None, "how much", None, None]
    codes = values(spark, query_text.code, ["lốp 195/65R15 còn hàng không?", "khi nào về 2-R17", "giá '2-R13 155/80 LPD' nhé", "Thông tư 09/2020", "không có mã", None])
    assert [r and r.keyword for r in codes] == ["195/65R15", "2-R17", "2-R13 155/80 LPD", None, None, None]
    assert values(spark, query_text.all_codes, ["so sánh 195/65R15 và 205/55R16, G/P", None]) == [["195/65R15", "205/55R16"], []]
    assert values(spark, query_text.asks_price, ["giá lốp X bao nhiêu", "giao hàng", "bao tiền một buổi", None, ""]) == [True, False, True, False, False]
    asked = ["tóm tắt các dịch vụ", "tổng quan về bảng giá", "tất cả dịch vụ là gì", "toàn bộ danh mục", "give me an overview", "giá dịch vụ A là bao nhiêu", "", None]
    assert values(spark, query_text.asks_summary, asked) == [True] * 5 + [False] * 3


def test_amounts(spark):
    cases = {"2tr": 2_000_000, "500k": 500_000, "1.5 triệu": 1_500_000, "2tỷ": 2_000_000_000, "300": 300, "2,5 triệu": 2_500_000, "": None, "abc": None, "1.200.000": 1_200_000, "700,000": 700_000, "1tr499": 1_499_000}
    assert values(spark, numbers.money, list(cases)) == list(cases.values())


def brute_redact(t):
    found = [(m.start(), m.start() - m.end(), k, kind) for k, (kind, p) in enumerate(pii.PATTERNS) for m in re.finditer(p, t)]
    out, at = [], 0
    for start, less, _, kind in sorted(found):
        if start >= at:
            out += [t[at:start], f"[{kind}]"]
            at = start - less
    return "".join([*out, t[at:]])


def test_personal_data(spark):
    literal = {
        "CCCD 012345678901.": "CCCD [CCCD].",
        "gọi 0901234567 nhé": "gọi [PHONE] nhé",
        "gọi 0901 234 567": "gọi [PHONE]",
        "mail a.b+c@x-y.co.uk": "mail [EMAIL]",
        "card 4111 1111 1111 1111": "card [CARD]",
        "sk-abcDEF_1234567890-xyzXYZ": "[API_KEY]",
        "postgres://u:p@host/db": "[DSN]/db",
        "xe 51F 678.90 đỗ": "xe [VN_PLATE] đỗ",
        "nothing here": "nothing here",
        "": "",
        None: None,
    }
    assert values(spark, pii.redact, list(literal)) == list(literal.values())
    odd = ["0123 4567 8901 0901234567 a@b.c", "é@ü.đ tok_ABCDEFGHIJKLMNOP 12345678901234567890123", "eyJabcdefghijk.abcdefghijkl.abcdefghijkl 29-A1 234.56", "1234-5678-9012-3456 0912-345-678,+84912345678"]
    assert values(spark, pii.redact, odd) == [brute_redact(t) for t in odd]
    assert values(spark, pii.count, [*odd[:1], "x", None]) == [3, 0, None]


def brute_orphans(chunks, short, most):
    """As a list walked from the left."""
    out, waiting = [], []
    for c in chunks:
        if len(c) < short:
            waiting.append(c)
        elif waiting and sum(map(len, waiting)) + len(waiting) + len(c) <= most:
            out.append("\n".join([*waiting, c]))
            waiting = []
        else:
            out += [*waiting, c]
            waiting = []
    tail = "\n".join([*out[-1:], *waiting])
    return [*out[:-1], tail] if out and waiting and len(tail) <= most else out + waiting


@pytest.mark.parametrize("most", [30, 60, 1024])
def test_orphans(spark, most):
    import random

    rng = random.Random(most)
    docs = [[("x" * rng.choice([0, 1, 3, 12, 25, 40])) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    rows = [(d, i, c) for d, chunks in enumerate(docs) for i, c in enumerate(chunks)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")
    got = {}
    for r in chunking.merge_orphans(df, 10, most).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {d: brute_orphans(c, 10, most) for d, c in enumerate(docs)}


def test_accents(spark):
    assert values(spark, structured.fold, ["Lốp xe ô tô giá dưới ĐỒNG", "éố", "Łódź ǅ", None])[:2] == ["lop xe o to gia duoi dong", "eo"]
    assert values(spark, text.strip_marks, ["Lốp Xe Ấy đi", "Ế", None]) == ["Lop Xe Ay đi", "E", None]
    rows = spark.createDataFrame([("Lốp xe",), ("khác",)], "t string")
    assert rows.where(structured.fold(F.col("t")).contains("lop xe")).count() == 1


def test_complexity(spark):
    cases = ["Điều 22 quy định gì", "so sánh Điều 22 và Điều 55", "a, b, c, d và e", "", None, "Hello, world?"]
    got = values(spark, text.query_complexity, cases)
    assert [round(x, 6) for x in got] == [0.0, round(0.4 + 0.6 + 7 / 20, 6), round(1.0 + 0.4 + 6 / 20, 6), 0.0, 0.0, 0.1]
    assert values(spark, lambda c: text.query_is_complex(text.query_complexity(c)), cases) == ["simple", "complex", "complex", "simple", "simple", "simple"]


def test_profiles_and_strategies(spark):
    prose = "This is a sentence of eight words today. " * 60
    docs = {
        0: "a,b,c\n1,2,3\n4,5,6\n7,8,9",
        1: "# T\n\n## A\ntext here\n## B\nmore text\n## C\nend",
        2: "Chương I\nĐiều 1. Phạm vi\nĐiều 2. Đối tượng\nnội dung",
        3: prose,
        4: "| a | b |\n|---|---|\n| 1 | 2 |\n\ntext\n| c | d |\n# H\n| e | f |",
        5: "Mục lục\nA .... 3\nshort line.",
        6: None,
        7: "```\ncode here.\n```\n$x$ ![i](u)",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    p = {r.doc_id: r for r in chunking.profile(df).collect()}
    assert p[0].is_csv_format and p[0].table_count == 1 and p[0].total_words == 0
    assert (p[1].h1, p[1].h2, p[1].total_headings, p[1].total_words) == (1, 3, 4, 5)
    assert p[2].statute_parts == 3
    assert p[4].table_count == 2 and p[4].total_words == 1  # a heading doesn't end a table
    assert p[5].has_toc and p[6].total_words == 0
    assert (p[7].code_block_count, p[7].formula_count, p[7].image_count, p[7].mixed_content_score) == (1, 1, 1, 0.5)
    s = {r.doc_id: (r.strategy, r.confidence) for r in chunking.select_strategy(chunking.profile(df)).collect()}
    assert s[0] == ("table_csv", 1.0) and s[1] == ("hdt", 1.0) and s[2] == ("hdt", 1.0)
    assert s[3] == ("semantic", 0.9)  # 480 words in one line: length full, few headings, no tables
    assert s[6] == ("recursive", 0.5)
