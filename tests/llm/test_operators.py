"""The corpus operators against plain versions on small tables with odd rows."""

import os
import sys
import zlib

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from telemetra.llm import (  # noqa: E402
    bpe,
    bytedup,
    chat,
    decontaminate,
    neardup,
    quality,
    queries,
    sharding,
    substrings,
    suffixes,
    token_store,
    toxicity,
)

SMALL = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def passage(start, n):
    return " ".join(WORDS[start : start + n])


#: Null, empty, tiny, long, repeated and overlapping texts.
TEXTS = [
    (0, passage(0, 60)),
    (1, None),
    (2, ""),
    (3, "one"),
    (4, passage(30, 60) + "\n" + passage(200, 25)),
    (5, passage(0, 60)),
    (6, ("x y " + passage(210, 15) + " ") * 40),
    (7, passage(100, 30) + " Ünïcode 中文 😀 <|endoftext|> it's\x00 \r\n  end  "),
    (8, "A b C d"),
    (9, "a B c D"),
    (None, passage(5, 40)),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns that could clash with the operators' own."""
    rows = [(i, t, "en", 1, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, key int, m int")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.TOKENIZER)


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(60):
        strings = [bytes(rng.integers(97, 100, rng.integers(0, 15)).tolist()) for _ in range(9)]
        at = np.r_[0, np.cumsum([len(s) for s in strings])]
        data = np.frombuffer(b"".join(strings), np.uint8)
        order, rank = suffixes.suffix_array(data, at)
        every = sorted((s[k:], at[i] + k) for i, s in enumerate(strings) for k in range(len(s)))
        assert order.tolist() == [p for _, p in every]
        shared = suffixes.common_prefixes(data, at, order, rank)
        for place in range(1, len(every)):
            a, b = every[place - 1][0], every[place][0]
            assert shared[place] == len(os.path.commonprefix([a, b]))


def test_variable_length_ranks():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, 7], np.uint32)
    for n in range(len(ranks) + 1):
        control, data = token_store.pack(ranks[:n])
        assert len(control) == -(-n // 4)
        assert token_store.unpack(control, data, n).tolist() == ranks[:n].tolist()


def test_token_store(spark, docs, tokenizer):
    folder = token_store.store_folder(spark)
    token_store.write_store(docs, queries.TOKENIZER, folder)
    got = {r["doc_id"]: r for r in token_store.read_store(spark, folder).collect()}
    start = 0
    for doc, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(ids_of(tokenizer, text), 0).astype("<u4")
        row = got[doc]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert bytes(row["ids"]) == ids.tobytes()
        start += len(ids)


def test_token_store_of_nothing(spark, docs):
    folder = token_store.store_folder(spark)
    token_store.write_store(docs.limit(0), queries.TOKENIZER, folder)
    assert token_store.read_store(spark, folder).count() == 0


def test_bpe(docs, tokenizer):
    coded = bpe.decode(bpe.encode(docs, queries.TOKENIZER), queries.TOKENIZER)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    for row in coded.collect():
        ids = ids_of(tokenizer, row["text"])
        assert bytes(row["ids"]) == ids.tobytes()
        assert row["decoded"] == tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def test_near_duplicates(spark, docs):
    near = [(20 + k, passage(0, 50) + f" e{k} " + passage(51, 9 + k % 3)) for k in range(30)]
    rows = [(i, t) for i, t in TEXTS if i is not None] + near
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((4, 80), (5, 80), (2, 60)):
        got = neardup.near_duplicates(table, words, percent).collect()
        want = brute.near_groups(rows, words, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    with_null = neardup.near_duplicates(docs, 4, 80).collect()
    assert len(with_null) == len(TEXTS)


def test_one_row_of_each_group(spark):
    """Decisions are made by row: shared ids, null ids and equal rows."""
    a, b, c, d = (passage(k * 60, 50) for k in range(4))
    rows = [
        (3, a, 0), (7, b, 1), (7, a + " more", 2),  # rows under 7 are judged apart
        (9, c, 3), (9, c, 4),  # equal rows: one of them
        (None, d, 5), (None, d, 6), (None, passage(300, 40), 7), (None, passage(345, 40), 8),
        (20, d + " and", 9), (30, "", 10), (30, "", 11), (31, None, 12), (5, b, 13),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, _doc int").withColumnRenamed("_doc", "_tie")
    kept = neardup.one_of_each_group(table, 5, 80)
    assert kept.columns == table.columns
    left = sorted(r["_tie"] for r in kept.collect())
    assert left in [sorted([0, 13, x, y, 7, 8, 10, 11, 12]) for x in (3, 4) for y in (5, 6)]
    assert neardup.one_of_each_group(table.limit(0)).count() == 0


def test_many_rows_without_id(spark):
    rows = [(None, passage(k % 300, 30)) for k in range(0, 900, 3)] + [(1, passage(0, 30))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["text"] for r in neardup.one_of_each_group(table, 5, 80).collect()]
    want = brute.near_groups([(t, t) for t in {t for _, t in rows}], 5, 80)
    assert len(kept) == len({top for _, top in want.values()}) == len({want[t][1] for t in kept})


def test_dense_buckets(spark, monkeypatch):
    """The bound on rare shingles loses no link."""
    monkeypatch.setattr(neardup, "DENSE", 0)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        words = WORDS[:60].copy()
        for at in rng.integers(0, 60, rng.integers(0, 5)):
            words[at] = f"r{rng.integers(0, 30)}"
        rows.append((k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table, 4, 80).collect()}
    assert got == brute.near_groups(rows, 4, 80)


def test_substrings(spark, docs):
    got = substrings.remove_repeats(docs, 20)
    assert got.columns == [*docs.columns, "repeats"]
    found = {
        r["doc_id"]: (r["repeats"]["n_words"], r["repeats"]["n_removed"], brute.sha(r["repeats"]["kept"]))
        for r in got.collect()
    }
    assert found == brute.removed_words(TEXTS, 20)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    # equal rows are one document; other texts under one id have an order
    twice = spark.createDataFrame(
        [(1, passage(0, 30)), (1, passage(0, 30)), (1, passage(5, 25))], "doc_id long, text string"
    )
    gone = sorted(r["repeats"]["n_removed"] for r in substrings.remove_repeats(twice, 20).collect())
    assert gone in ([0, 0, 25], [0, 25, 25])


def test_byte_repeats(docs, monkeypatch):
    want = brute.removed_bytes(TEXTS, 50)
    for shard in (1 << 20, 300):  # one shard, and many that hand windows on
        monkeypatch.setattr(bytedup, "SHARD_BYTES", shard)
        got = bytedup.remove_repeats(docs, 50)
        found = {
            r["doc_id"]: (*list(r["repeats"])[:3], brute.sha(bytes(r["repeats"]["kept"])))
            for r in got.collect()
        }
        assert found == want
    assert bytedup.remove_repeats(docs.limit(0)).count() == 0


def test_shards_hand_windows_on():
    """Strings of one anchor over several shards give what one shard gives."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 123, 90).tolist())
    rows = []
    for doc in range(40):
        string = bytearray(base)
        string[rng.integers(0, 90)] = 65 + doc % 26
        rows.append((0, 7, doc, 0, 0, 41, bytes(string)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c).cast(f.type) for c, f in zip(zip(*rows), bytedup._STRING_ARROW)],
        schema=bytedup._STRING_ARROW,
    )

    def judged():
        parts = [b for b in bytedup._judge(50)(iter([batch.slice(k, 8) for k in range(0, 40, 8)]))]
        spans = [r for b in parts for r in b.to_pylist()]
        return sorted((r["_doc"], k) for r in spans for k in range(r["pos"], r["pos"] + r["m"]))

    whole = judged()
    seen, want = {}, []
    for _, _, doc, _, _, m, string in rows:
        for k in range(m):
            if seen.setdefault(string[k : k + 50], doc) < doc:
                want.append((doc, k))
    assert whole == sorted(want)
    old = bytedup.SHARD_BYTES
    try:
        bytedup.SHARD_BYTES = 400
        assert judged() == whole
    finally:
        bytedup.SHARD_BYTES = old


def hot_texts(n):
    """Texts around one 16-byte phrase that is the anchor of most windows it stands in."""
    from telemetra.llm import arrays

    phrases = [b"Posted by %05d:" % k for k in range(4000)]
    hashes = [arrays.gram_hashes(bytedup._UNITS[np.frombuffer(p, np.uint8)], 16)[0] for p in phrases]
    phrase = phrases[int(np.argmin(hashes))].decode()
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 34))) for _ in range(n)]
    rows = [(k, f"{words[k]}{phrase}{words[-k - 1]}") for k in range(n)]
    rows += [(n + k, f"{words[k][-20:]}{phrase}{words[-k - 1][:20]}") for k in range(0, n, 3)]
    return rows + [(2 * n, "  ".join(rows[k][1] for k in range(0, n, 7)) * 2)]


def test_hot_anchor_is_spread(spark, monkeypatch):
    """An anchor of many different strings does not meet in one task."""
    from telemetra.llm.common import keyed
    from telemetra.session import ship_package

    rows = hot_texts(600)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(bytedup, "HOT_STRINGS", 64)
    monkeypatch.setattr(bytedup, "SAMPLE", 1)
    monkeypatch.setattr(bytedup, "HELD", 500)
    ship_package(spark)
    hot = bytedup.hot_anchors(table, 50)
    assert len(hot)
    _, strings = bytedup.compared_strings(keyed(table), 50, hot)
    most = strings.groupBy("deal", "hash").count().agg(F.max("count")).first()[0] or 0
    assert most < 64
    _, strings = bytedup.compared_strings(keyed(table), 50, hot[:0])
    assert strings.groupBy("deal", "hash").count().agg(F.max("count")).first()[0] > 600
    got = {
        r["doc_id"]: (*list(r["repeats"])[:3], brute.sha(bytes(r["repeats"]["kept"])))
        for r in bytedup.remove_repeats(table, 50).collect()
    }
    assert got == brute.removed_bytes(rows, 50)


def test_decontamination(spark, docs):
    items = [(1, passage(10, 14)), (2, "A, b. C!"), (3, None), (None, "中文"), (1, passage(10, 14))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute.marked(TEXTS, [("" if i is None else i, t) for i, t in items], 10)
    for block in (1 << 20, 2):  # one broadcast, and several in turn
        got = decontaminate.mark(docs, benchmark, block_windows=block)
        found = {
            r["doc_id"]: (r["leak"]["n_words"], r["leak"]["n_hit"], sorted(r["leak"]["items"]))
            for r in got.collect()
        }
        assert found == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # blocks are passes of their own
    # one window in very many items is spread over blocks
    many = spark.createDataFrame([(k, passage(10, 10)) for k in range(50)], "item_id long, text string")
    hit = decontaminate.mark(docs.filter("doc_id = 0"), many, block_windows=7).first()["leak"]
    assert len(hit["items"]) == 50 and hit["n_hit"] == 10
    cut = decontaminate.remove_spans(got)
    again = decontaminate.mark(cut.filter("doc_id = 0"), benchmark.limit(1)).first()
    assert again["leak"]["n_hit"] == 0 and again["leak"]["n_words"] == 60 - 14
    none = decontaminate.mark(docs, benchmark.limit(0))
    assert none.agg(F.sum("leak.n_hit")).first()[0] == 0


def test_anchors_do_not_depend_on_the_slice():
    """A text alone and within slices of other lengths has the same anchors."""
    from telemetra.llm import arrays

    rng = np.random.default_rng(6)
    text = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    alone = arrays.anchors(text, np.array([0, 400]), 50, 16)
    for more in (1, 700, 70_000):
        units = np.r_[text, rng.integers(0, 1 << 62, more).astype(np.uint64)]
        spot, count, hashes = arrays.anchors(units, np.array([0, 400, len(units)]), 50, 16)
        mine = spot < 400
        assert all(np.array_equal(x, y[mine]) for x, y in zip(alone, (spot, count, hashes)))


def test_input_columns_with_internal_names(spark):
    rows = [(1, passage(0, 30), 5, 6, "x", "y"), (2, passage(0, 30), 7, 8, "z", "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _spans int, _tie int, _doc string, _code string")
    for found in (substrings.remove_repeats(table, 20), bytedup.remove_repeats(table, 50)):
        assert found.columns == [*table.columns, "repeats"]
        got = {r["doc_id"]: tuple(r)[2:6] for r in found.collect()}
        assert got == {r[0]: r[2:] for r in rows}
    talk = spark.createDataFrame([(1, 0, "u", "a", 3, 4)], "conv_id long, turn long, role string, text string, _c int, _t int")
    assert (chat.thread(talk).first()["_c"], chat.thread(talk).first()["_t"]) == (3, 4)


def test_sharding(spark, docs):
    table = sharding.fill(queries.SHARDS)
    share = np.bincount(table)
    assert share.max() - share.min() <= 1
    fewer = sharding.fill(queries.SHARDS[:-1])
    stay = table < len(queries.SHARDS) - 1
    assert (table[stay] == fewer[stay]).mean() > 0.9
    placed = sharding.place(docs, "doc_id", queries.SHARDS)
    names = np.array(queries.SHARDS)[table]
    rows = placed.collect()
    assert len(rows) == len(TEXTS) and all(names[r["slot"]] == r["shard"] for r in rows)
    with pytest.raises(ValueError):
        sharding.fill(["a", "b"], 10)


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are  you?"),
        (1, 1, "assistant", "> hello there\nFine!\n\nAnd you?"),
        (1, 2, "user", "On Mon A wrote:\n>> Hello there\n> Fine!\nme too"),
        (1, 2, "user", "On Mon A wrote:\n>> Hello there\n> Fine!\nme too"),
        (1, 3, "user", "> nobody said\nok"),
        (2, 0, "user", None),
        (2, 1500, "user", "common"),
        (2, 3000, None, "> common\nx"),
        (2, 3001, "a", "> x"),
        (None, 1, "user", "> Fine!"),
        (1, None, "u", "> ok"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.thread(table).collect()}
    assert chat.thread(table).count() == len(rows)
    link = {k: (r["parent_turn"], r["root_turn"], r["depth"]) for k, r in got.items()}
    assert link[1, 1] == (0, 0, 1) and link[1, 2] == (1, 0, 2) and link[1, 3] == (None, 3, 0)
    assert link[2, 3000] == (1500, 1500, 1) and link[2, 3001] == (3000, 1500, 2)
    assert link[None, 1][0] is None and link[1, None][0] is None
    assert got[1, 2]["body"] == "me too" and got[1, 1]["body"] == "Fine!\n\nAnd you?"
    assert got[2, 3000]["rendered"] == "<||>\nx"
    assert chat.thread(table.limit(0)).count() == 0


def test_quality_counts(spark, docs):
    crf = quality.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    rows = [(*r, "") for r in TEXTS] + [(11, "a b c\na b c\n\n# x | y\na b c", "")]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["quality_rules"] for r in quality.judge(table, crf).collect()}
    assert (got[11]["n_words"], got[11]["n_symbols"], got[11]["n_dup_lines"]) == (13, 2, 2)
    assert got[11]["n_repeat_words"] == 9 and got[11]["base_failed"] and not got[11]["kept"]
    assert got[0]["kept"] and not got[1]["kept"]
    assert got[6]["base_failed"]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    crf = quality.Crf(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    x, rows = rng.normal(size=(12, 3)), np.array([0, 5, 5, 6, 12])
    label = crf.decode(x, rows)

    def score(path, part):
        total = crf.first[path[0]]
        total += sum(crf.change[a, b] for a, b in zip(path, path[1:]))
        return total + sum(part[i] @ crf.emit for i, y in enumerate(path) if y)

    for low, high in zip(rows, rows[1:]):
        n = high - low
        if n:
            paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
            best = max(paths, key=lambda p: score(p, x[low:high]))
            assert label[low:high].tolist() == best


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op9_toxicity(spark, folder).toPandas()
    labels = pd.read_parquet(f"{folder}/labels.parquet").merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert all(held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2))
    assert (held.toxic == held.predicted).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert toxicity.score(docs, model).agg(F.max("score")).first()[0] < 0.01


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    rows = [(i, t) for i, t in TEXTS] + [(50, passage(300, 60)), (51, passage(300, 60) + " more")]
    rows += [(60, passage(120, 70)), (61, "own words first " + passage(120, 70) + " and last")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    near = pipeline.one_of_each_group(spark, docs, SMALL)
    kept = {r["doc_id"] for r in near.collect()}
    want = brute.near_groups([r for r in rows if r[0] is not None], 5, 80)
    assert kept == {None} | {d for d, (_, top) in want.items() if d == top}
    cut = {r["doc_id"]: r["text"] for r in pipeline.repeats_out(spark, docs.filter("doc_id >= 60"), SMALL).collect()}
    assert cut[60] == passage(120, 70) and cut[61].split() == "own words first and last".split()
    out = pipeline.run(spark, SMALL)
    assert out.count() > 100 and out.filter("NOT round_trip").isEmpty()


def test_pipeline_against_a_plain_version(spark, tokenizer, tmp_path):
    """All five stages on documents with planted copies, passages, leaks and toxic rows."""
    import corpus_pipeline as pipeline

    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    base = table.text.iloc[3]
    leak = items.text.iloc[0]
    planted = [
        base, base + " one more", passage(0, 80) + " " + leak, leak, passage(0, 80) + " other " + passage(200, 60),
        "new " + passage(200, 60) + " end", "", None, "tiny",
    ]
    more = table.iloc[: len(planted)].copy()
    more["doc_id"] = range(90_000, 90_000 + len(planted))
    more["text"] = planted
    pd.concat([table, more]).to_parquet(tmp_path / "documents.parquet", index=False)
    for name in ("labels", "benchmark"):
        pd.read_parquet(f"{SMALL}/{name}.parquet").to_parquet(tmp_path / f"{name}.parquet", index=False)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    toxic = {r[0] for r in toxicity.score(docs, model).filter("score >= 0.3").select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute.pipeline(rows, list(zip(items.item_id, items.text)), toxic, tokenizer)
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and toxic and len(want) < len(rows) - len(toxic)
    for doc, ids in want.items():
        assert np.frombuffer(bytes(got[doc]["ids"]), "<u4").tolist() == ids and got[doc]["round_trip"]


def test_registered_queries_against_the_library(spark, tokenizer):
    """The digests of op1, op3 and op4 on a small table, from the library and plain versions."""
    table = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    start, one, three = 0, {}, {}
    for doc, text in zip(table.doc_id, table.text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        raw = np.array([*ids, 0], "<u4").tobytes()
        one[doc] = (start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1
        three[doc] = (len(ids), brute.sha(raw[:-4]), brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))
    for name, want in (("op1_token_store", one), ("op3_bpe", three)):
        assert {r[0]: tuple(r)[1:4] for r in queries.QUERIES[name](spark, SMALL).collect()} == want
    leaks = brute.marked(list(zip(table.doc_id, table.text)), list(zip(items.item_id, items.text)), 10)
    want = {d: (n, hit, len(found), brute.sha(",".join(found)), hit > 0) for d, (n, hit, found) in leaks.items()}
    got = {r[0]: tuple(r)[1:] for r in queries.op4_decontamination(spark, SMALL).collect()}
    assert got == want and any(r[4] for r in want.values())


@pytest.mark.parametrize("name", ["op6_substrings", "op10_suffix_arrays", "op2_near_duplicates"])
def test_queries_on_the_small_tables(spark, name):
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    rows = list(zip(table.doc_id, table.text))
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES[name](spark, SMALL).collect()}
    if name == "op6_substrings":
        assert got == brute.removed_words(rows, 20)
    elif name == "op10_suffix_arrays":
        assert got == brute.removed_bytes(rows, 50)
    else:
        assert {d: v[:2] for d, v in got.items()} == brute.near_groups(rows, 4, 80)
