"""Vocabulary, compression, superlatives; streams with states and timers; the source and the table functions."""

import datetime as dt
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import language
from lakeloom.plans import catalog, catalog_language
from lakeloom.sources import surface
from lakeloom.sources.readers import html_text
from lakeloom.streaming import stateful


def test_vocabulary(spark):
    asked = spark.createDataFrame([(1, "Không bán retail, bán retail!"), (2, "sp mới sp?"), (3, ""), (4, None), (5, "(c++) is not sp")], "query_id long, text string")
    words = spark.createDataFrame([("bán retail", "generic", ["bán lẻ"]), ("sp", "generic", ["sản phẩm", "x"]), ("sp", "bot_custom", ["spa"]), ("c++", "generic", ["cpp $1"])], "phrase string, source string, expansions array<string>")
    got = language.vocabulary_matches(asked, words, ["không"])
    assert sorted((r.query_id, r.place, r.at, r.n, r.phrase, r.source) for r in got.collect()) == [(1, 1, 3, 2, "bán retail", "generic"), (2, 1, 0, 1, "sp", "bot_custom"), (5, 1, 0, 1, "c++", "generic"), (5, 2, 3, 1, "sp", "bot_custom")]
    assert language.vocabulary_matches(asked.where("query_id = 1"), words, []).first().at == 1
    variants = {(r.query_id, r.place): r.variant for r in language.vocabulary_variants(asked, got).collect()}
    assert variants[2, 0] == "sp mới sp?" and variants[2, 1] == "spa mới spa?" and (3, 0) not in variants and (4, 0) not in variants


def test_registered_variants(spark, sf_dir):
    asked = {r.query_id: r.text for r in catalog_language._asked(spark, sf_dir).collect()}
    want = {(i, 0, t) for i, t in asked.items()}
    matches = {}
    for r in language.vocabulary_matches(catalog_language._asked(spark, sf_dir), catalog_language._vocabulary(spark, sf_dir), catalog_language.NEGATIONS).orderBy("query_id", "place").collect():
        matches.setdefault(r.query_id, []).append((r.phrase, r.expansions))
    for i, found in matches.items():
        made = []
        for phrase, expansions in found:
            for e in expansions:
                new = re.sub(rf"\b{re.escape(phrase)}\b", lambda _, e=e: e, asked[i].lower())
                if new not in (asked[i], asked[i].lower(), *made) and len(made) < 5:
                    made.append(new)
        want |= {(i, k, v) for k, v in enumerate(made, 1)}
    assert {tuple(r) for r in catalog.QUERIES["vocabulary_variants"](spark, sf_dir).select("query_id", "place", "variant").collect()} == want


def test_compression_keeps_what_tells(spark):
    filler, fact = "the of to in the of to in the of to.", "Price is 1,500,000 VND on 12/05 with 20% off."
    rows = [(1, f"# **Head**\nSee [here](http://x.y).   Short text."), (2, " ".join([filler] * 9 + [fact] + [filler] * 9)), (3, " ".join([filler] * 30)), (4, "x" * 900), (5, None), (6, f"No mark at the end\n{fact}\n" + f"{filler}\n" * 12)]
    got = {r.id: r.text for r in language.compressed(spark.createDataFrame(rows, "id long, text string"), "id", ["the", "of", "to", "in"], ["not"], 300).collect()}
    assert got[1] == "Head\nSee here. Short text." and got[2] == fact and got[4] == "x" * 300 and got[5] == ""
    assert got[3] == " ".join([filler] * 8) and got[6] == f"No mark at the end {fact}"


@pytest.mark.parametrize(("question", "wanted"), [("gói nào ĐẮT NHẤT", "max_price"), ("cheapest plan", "min_price"), ("how long", None), ("giảm giá nhiều nhất", "max_discount"), ("The fastest one", "shortest_duration"), ("vipers", None), ("most gifts", "max_bonus")])
def test_intents(spark, question, wanted):
    assert spark.createDataFrame([(question,)], "q string").select(language.intent(F.col("q"))).first()[0] == wanted


def test_superlatives(spark):
    text = "Gói VIP: 1.500.000đ, giảm 30%\nGói thường: 700,000 VND tặng 3 buổi\nGói VIP 90 phút\nGói rẻ: 200.000đ\nno price: 12"
    chunks = spark.createDataFrame([(1, 0, text), (1, 1, "Gói rẻ: 250.000 đồng"), (2, 0, None)], "grp long, chunk int, text string")
    items = language.ranked_items(chunks)
    got = {r.name: (r.place, r.price, r.duration, r.discount, r.bonus) for r in items.collect()}
    assert got == {"Gói VIP": (1, 1_500_000, 90, 30, None), "Gói thường": (2, 700_000, None, None, 3), "Gói rẻ": (3, 250_000, None, None, None)}
    asks = spark.createDataFrame([(7, 1, "gói rẻ nhất"), (8, 1, "longest"), (9, 1, "hello"), (10, 2, "cheapest")], "query_id long, grp long, text string")
    assert [(r.query_id, r.rank, r.name, r.value) for r in language.superlatives(asks, items).orderBy("query_id", "rank").collect()] == [(7, 1, "Gói rẻ", 250_000), (7, 2, "Gói thường", 700_000), (7, 3, "Gói VIP", 1_500_000), (8, 1, "Gói VIP", 90)]


# ---- streams ----


@pytest.fixture
def states(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stateful.keep_states(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def stream(spark, tmp_path, batches, schema, make, name):
    """The rows of a stream over one file after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i:03}")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    q = make(read).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    q.awaitTermination(150)
    return sorted((tuple(r) for r in spark.table(name).collect()), key=repr)


T0 = 1_704_067_200_000


def test_life_cycle_refuses_steps_and_forgets(spark, tmp_path, states):
    batches = [[("d", at(0), "DRAFT"), ("d", at(1), "ACTIVE"), ("d", at(2), "PROCESSING")], [("d", at(3), "ACTIVE"), ("e", at(4), "PROCESSING")], [("z", at(500), "DRAFT")], [("z", at(501), "FAILED")], [("z", at(502), "DRAFT")]]
    got = stream(spark, tmp_path, batches, "key string, ts timestamp, step string", lambda s: stateful.life_cycle(s, forget_s=60, late="1 second"), "life")
    assert [r for r in got if r[0] == "d"] == sorted([
        ("d", T0, "", "DRAFT", True), ("d", T0 + 1000, "DRAFT", "ACTIVE", False), ("d", T0 + 2000, "DRAFT", "PROCESSING", True), ("d", T0 + 3000, "PROCESSING", "ACTIVE", True),
        ("d", T0 + 63_000, "ACTIVE", "", True),  # forgotten a minute after its last step
    ], key=repr)
    assert ("e", T0 + 4000, "", "PROCESSING", False) in got and ("z", T0 + 502_000, "FAILED", "DRAFT", False) in got


def test_messages_come_back_until_they_are_dead_letters(spark, tmp_path, states):
    batches = [[("m", at(0), "p", False), ("ok", at(0), "q", False)], [("ok", at(10), "q", True)], *[[("tick", at(t), "t", True)] for t in (31, 62, 93, 124, 155, 186)]]
    got = stream(spark, tmp_path, batches, "key string, ts timestamp, payload string, acked boolean", lambda s: stateful.pending_messages(s, 30, 3), "pending")
    assert [r[3:] for r in sorted((r for r in got if r[0] == "m"), key=lambda r: r[1])] == [(1, "sent"), (2, "again"), (3, "again"), (3, "dead")]
    assert [r for r in got if r[0] == "ok"] == [("ok", T0, "q", 1, "sent")]


def test_registered_life_cycle(spark, sf_dir, states):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", F.expr(catalog_language.STEP).alias("step")).collect()
    step, want = {}, []
    for r in sorted(events, key=lambda r: r.ts):
        before = step.get(r.user_id, "")
        good = r.step in stateful.STEPS.get(before, ())
        step[r.user_id] = r.step if good else before
        want.append((r.user_id, before, r.step, good))
    got = [tuple(r) for r in catalog.QUERIES["step_life_cycle"](spark, sf_dir).where("step <> ''").select("key", "before", "step", "accepted").collect()]
    assert sorted(got) == sorted(want)


def test_drift(spark):
    rows = [("the cut costs 100", "wash", 100.0, ["wash", "cut"], [100.0]), ("wash costs 150", "Wash", 100.0, ["wash", "cut"], [150.0]), ("a wash for 100.5", "wash", 100.0, ["cut"], [100.5]), (None, None, None, None, None), ("cut", None, 5.0, ["cut"], None), ("wash 100 or 150", "wash", 100.0, ["cut"], [100.0, 150.0])]
    df = spark.createDataFrame(rows, "answer string, name string, price double, names array<string>, prices array<double>")
    got = [r[0] for r in df.select(stateful.drift(F.col("answer"), F.col("name"), F.col("price"), F.col("names"), F.col("prices"))).collect()]
    assert got == [["service_drift"], ["price_drift"], [], [], [], []]


# ---- surfaces ----


def _zip(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


@pytest.mark.parametrize(
    ("path", "content", "kind"),
    [("a/x.md", b"# t", "markdown"), ("x", b"%PDF-1.7", "pdf"), ("x.docx", b"not a zip", "txt"), ("x", _zip("word/document.xml"), "docx"), ("x.bin", _zip("xl/a"), "xlsx"), ("x", _zip("ppt/a"), "pptx"), ("x", _zip("a"), "zip"), ("x", b"PK\x03\x04broken", "zip"), ("part.txt", b" <!DOCTYPE html><p>", "html"), ("x", b"\x00", "binary"), ("x", b"\xff\xfe", "binary"), ("x.txt", "né".encode(), "txt")],
)
def test_kinds(path, content, kind):
    assert surface.kind_of(path, content) == kind


def test_source_packs_files_into_partitions(spark, tmp_path):
    surface.register(spark)
    for i in range(7):
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 2}" / f"f{i}.md").write_text("x" * 100)
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04")
    (tmp_path / "_skip").write_text("no")
    df = spark.read.format("documents").option("partitionBytes", 250).load(str(tmp_path))
    assert df.rdd.getNumPartitions() >= 3
    got = {r.path.rsplit("/", 1)[1]: r for r in df.collect()}
    assert sorted(got) == ["bad.xlsx", *(f"f{i}.md" for i in range(7))]
    assert "BadZipFile" in got["bad.xlsx"].error and got["f0.md"].text == "x" * 100


def test_registered_pages(spark, sf_dir):
    want = {r.page_id: html_text(r.html.encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() if r.html is not None}
    got = {r.page_id: r.text for r in catalog.QUERIES["page_files"](spark, sf_dir).collect()}
    assert got == want


def test_table_functions(spark):
    surface.register(spark)
    docs = spark.createDataFrame([(1, "aaa bbb\nccc"), (2, None), (3, "x" * 25), (4, "# A\nb\n## C\n#d")], "doc_id long, text string")
    cut = spark.sql("SELECT * FROM chunk_text(TABLE({docs}), 10)", docs=docs).orderBy("doc_id", "part").collect()
    assert [(r.doc_id, r.content) for r in cut] == [(1, "aaa bbb\n"), (1, "ccc"), (3, "x" * 10), (3, "x" * 10), (3, "x" * 5), (4, "# A\nb\n## "), (4, "C\n#d")]
    found = spark.sql("SELECT * FROM markdown_sections(TABLE({docs}))", docs=docs).where("doc_id = 4").orderBy("section").collect()
    assert [(r.level, r.title, r.body) for r in found] == [(1, "A", "b"), (2, "C", "#d")]
