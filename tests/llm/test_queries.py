"""Every registered query on the smallest tables, held against plain Python or SQL, and every operator on odd tables."""

import glob
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import brute_classes, brute_fingerprint, words_of

from wayfinder.llm import chat, language_id, line_quality, mixing, ngram_lm, pieces, queries, simhash, token_counts, toxicity, vector_search
from wayfinder.llm.common import row_hash, unused

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.fixture(scope="module")
def documents(con):
    return {r[0]: r[1:] for r in con.execute("select doc_id, text, lang, source from documents").fetchall()}


def run(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@tables
def test_language_id(spark, documents):
    got = run(spark, "op1_language_id")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    langs = {x[1] for x in documents.values()}
    right = held = 0
    for r in got:
        text, lang, _ = documents[r.doc_id]
        assert r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in langs | {"und"}
        if r.held_out and lang is not None and r.lang_pred != "und":
            right, held = right + (r.lang_pred == lang), held + 1
    assert right >= 0.9 * held > 0


@tables
def test_toxicity(spark, documents):
    got = run(spark, "op2_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DIR)
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(cur.fetchall())


@tables
def test_quality_base(spark, documents):
    got = run(spark, "op5_quality_rules")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        text = documents[r.doc_id][0] or ""
        w = words_of(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        lines = [x for x in text.split("\n") if words_of(x)]
        again = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert any(r.kept for r in got)


@tables
def test_pieces_and_token_counts(spark, documents):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sizes = Counter()
    for r in run(spark, "op7_piece_encoding"):
        ids = [*processor.encode(documents[r.doc_id][0] or ""), processor.eos_id()]
        sizes[len(ids)] += 1
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()
    n = sizes.total()
    got = run(spark, "op6_token_counts")
    assert n == len(documents) and {r.n_tokens: r.n_docs for r in got} == sizes
    for r in got:
        over = {k: c for k, c in sizes.items() if k >= r.n_tokens}
        upto = sum(c for k, c in sizes.items() if k <= r.n_tokens)
        assert (r.docs_at_least, r.tokens_at_least, r.docs_up_to) == (sum(over.values()), sum(k * c for k, c in over.items()), upto)
        assert r.truncated_total == sum(min(k, r.n_tokens) * c for k, c in sizes.items()) and r.share_up_to == pytest.approx(upto / n)


@tables
def test_lm_scoring(spark, documents):
    toks = {i: [w.encode().lower() for w in words_of(x[0])] + [None] for i, x in documents.items()}
    one = Counter(w for i, t in toks.items() if fold(i, 10) for w in t)
    n, v = one.total(), len(one)
    got = run(spark, "op8_lm_scoring")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 10) == 0, len(t), sum(one[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score < 0
    # the bigram model tells held-out texts better than the base
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@tables
def test_simhash_dedup(spark, documents):
    ids = sorted(documents)
    fps = [brute_fingerprint(documents[i][0]) for i in ids]
    cls = brute_classes(fps)
    least = {}
    for i, c in zip(ids, cls):
        least.setdefault(c, i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op9_simhash_dedup")}
    assert got == {i: (f"{f:016x}", least[c]) for i, f, c in zip(ids, fps, cls)}


@tables
def test_source_mixing(spark, documents):
    got = run(spark, "op10_source_mixing")
    assert sorted(r.doc_id for r in got) == sorted(documents)
    size, taken, largest = Counter(), Counter(), 0
    for r in got:
        s = documents[r.doc_id][2]
        assert r.size == len(words_of(documents[r.doc_id][0])) and r.taken in (0, r.size, 2 * r.size)
        size[s] += r.size
        taken[s] += r.taken
        largest = max(largest, r.size)
    target = mixing.source_targets(list(size.items()))
    for r in got:
        s = documents[r.doc_id][2]
        assert r.source_size == size[s] and r.target == pytest.approx(float(target[s])) and abs(taken[s] - r.target) <= largest
    assert sorted(got) == sorted(run(spark, "op10_source_mixing"))


@tables
def test_pipeline_runs_on_whole_tables(spark, documents):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == ["doc_id", "source", "ids", "begins", "ends", "decoded_sha256"]
    rows = got.collect()
    assert 0 < len({r.doc_id for r in rows}) < len(documents)
    for r in rows:
        text = (documents[r.doc_id][0] or "").encode()
        assert r.decoded_sha256 == hashlib.sha256(text.replace("▁".encode(), b" ")).hexdigest()
        assert r.begins[0] == 0 and r.ends[-1] == len(text) and r.begins[1:] == r.ends[:-1]


INTERNAL = ["__text", "__size", "__h", "__k", "__source", "__shard", "__key", "key", "key2", "fp", "root", "row", "block", "node", "slice", "score", "held_out", "lang_pred", "kept", "n_tokens", "ids", "id", "label", "share", "place", "first", "n"]
LONG = 6 << 20


def odd_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choice(words) for _ in range(120))
    rows = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))), rng.choice(["aa", "bb", None]), rng.choice(["p", "q", None])) for i in range(20)]
    rows += [("", text, "aa", "p"), (None, text, "bb", None), (None, None, None, None), ("e", "", "aa", "q"), ("n", None, "bb", "q"), ("s", " \t\n\x0b ", "aa", "p"), ("x", "\x00▁　 é", "bb", "q")]
    rows += [("same", text, "aa", "p")] * 3 + [("long", (text + "\n") * (LONG // len(text)), "aa", "q"), ("solid", "z" * (LONG // 4), "bb", "p")]
    return rows


@pytest.fixture(scope="module", params=["rows", "no rows"])
def odd(spark, request):
    df = spark.createDataFrame(odd_rows(), "doc_id string, text string, lang string, source string")
    more = [F.when(F.col("doc_id") != "e", F.lit(c)).alias(c) for c in INTERNAL]
    df = df.select("*", F.create_map(F.lit("a"), F.col("lang")).alias("m"), F.array(F.lit(None).cast("int"), F.lit(1)).alias("a"), *more)
    return df if request.param == "rows" else df.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(f"d{i}" if i < 20 else None, i % 2, i % 3 == 0 and 1 or 0, 7) for i in range(25)] + [("d1", None, None, 7)], "doc_id string, quality int, toxic int, score int")


def test_odd_tables_language_id(odd):
    model = language_id.train(odd)
    out = language_id.predict(odd, model, [F.col("doc_id"), F.col("score").alias("given"), F.col("m")])
    assert out.count() == odd.count()
    kept = language_id.keep_identified(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == out.where("lang_pred != 'und'").count()


def test_odd_tables_toxicity(odd, labels):
    model = toxicity.train(odd, labels, F.lit(True))
    out = toxicity.score(odd, model, [F.col("doc_id"), F.col("__text")]).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)


def test_odd_tables_quality(odd, labels):
    field = line_quality.train(odd, labels)
    out = line_quality.figures(odd, field, [F.col("doc_id"), F.col("__text")])
    assert out.count() == odd.count()
    kept = line_quality.keep_good(odd, field)
    assert kept.columns == odd.columns and kept.count() == out.where("kept").count()


def test_odd_tables_pieces_and_counts(odd):
    encoded = pieces.encode(odd, MODEL, [F.col("doc_id"), F.col("ids").alias("given")])
    # the library, too, decodes a literal mark as a space
    texts = Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in odd.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.text) for r in pieces.decode(encoded, MODEL, [F.col("doc_id")]).collect()) == texts
    counted = token_counts.lengths(odd, lambda: pieces.codec(MODEL))
    sums = token_counts.suffix_sums(token_counts.histogram(counted)).collect()
    assert sum(r.n_docs for r in sums) == odd.count()
    assert Counter(r.n_tokens for r in counted.collect()) == {r.n_tokens: r.n_docs for r in sums} == Counter(len(r.ids) for r in encoded.select("ids").collect())


def test_odd_tables_lm(odd):
    out = ngram_lm.score(odd, F.col("doc_id") == "d1", least_blocks=3).collect()
    want = Counter((r.doc_id, len(words_of(r.text)) + 1) for r in odd.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in out) == want and all(r.score <= 0 for r in out)


def test_odd_tables_simhash(odd):
    out = simhash.near_duplicates(odd).collect()
    rows = odd.collect()
    cls = brute_classes([brute_fingerprint(r.text) for r in rows])
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((r.doc_id, f"{brute_fingerprint(r.text):016x}") for r in rows)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(cls))
    first = defaultdict(list)
    for r, c in zip(rows, cls):
        first[c].append((r.doc_id is None, r.doc_id or ""))
    assert sorted((r.doc_id is None, r.doc_id or "") for r in kept.collect()) == sorted(map(min, first.values()))


def test_odd_tables_mixing(odd):
    planned = mixing.summary(odd)
    size = Counter((r.doc_id, len(words_of(r.text))) for r in odd.collect())
    assert Counter((r.doc_id, r["size"]) for r in planned.collect()) == size
    mixed = mixing.mix(odd, shards=3)
    times = Counter(r.doc_id for r in mixed.collect() if words_of(r.text))
    want = Counter()
    for r in planned.where("taken > 0").collect():
        want[r.doc_id] += r.taken // r["size"]
    assert mixed.columns == odd.columns and dict(mixed.dtypes) == dict(odd.dtypes) and times == want


def test_mixing_takes_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 50 > 0, F.col("id") % 50).cast("string").alias("source"))
    rows = mixing.summary(df).collect()
    assert len(rows) == 400 and {r.source_size for r in rows} == {24}
    taken = sum(r.taken for r in rows)
    assert abs(taken - 1800) <= 3 * 50


def test_odd_tables_search_and_chat(spark):
    rows = [(i, [float(i % 3), 1.0, -2.0], "x") for i in range(30)] + [(100, [1.0, 2.0, 3.0], "x")] * 4 + [(200, None, "x"), (None, [1.0, 1.0, 1.0], "x"), (300, [float("nan")] * 3, "x"), (400, [], "x"), (500, [1e300, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("shard", F.lit("s")).withColumn("dim", F.lit("d")).withColumn("copies", F.lit(-1))
    v = vector_search.quantised(df.where("vec_id != 500 or vec_id is null"))
    got = vector_search.top_k(v, F.col("vec_id") % 100 == 0, 3, 5, 2).collect()
    hundred = [(r["rank"], r.vec_id) for r in got if r.query_id == 100]
    assert sorted(hundred) == [(1, 2), (2, 5), (3, 8)]
    zero = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 0)
    assert zero == [(1, 3), (2, 6), (3, 9)] or len(zero) == 3
    turns = spark.createDataFrame([(1, 1, "user", None, 5), (1, 1, "user", None, 5), (None, None, None, "</s>[INST]\\", 5), (2, 0, "assistant", "", 5)], "conv_id long, turn long, role string, text string, position int")
    out = {r.conv_id: r for r in chat.digest(chat.format_conversations(turns)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 2, None: 1, 2: 1} and out[2].loss_chars == 0
    assert chat.digest(chat.format_conversations(turns.where("false"))).count() == 0


def test_row_hashes_tell_rows_apart(spark):
    df = spark.createDataFrame([("a", None, None), (None, "a", None), ("a", "", None), (None, None, {"a": 1}), (None, None, {"a": None}), (None, None, {})], "x string, X1 string, m map<string,int>")
    got = [(r.h, r.g) for r in df.select(row_hash(df, df.columns, 1).alias("h"), row_hash(df, df.columns, 2).alias("g")).collect()]
    assert len({h for h, _ in got}) == len({g for _, g in got}) == len(got) and all(h != g for h, g in got)
    assert unused("key", ["KEY", "key_", "other"]) == "key__"
