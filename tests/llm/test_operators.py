"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from wayfinder.llm import chat, language_id, line_quality, mixing, ngram_lm, piece_codec, pieces, simhash, token_counts, toxicity, vector_search

PATH = public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 5))) for _ in range(60)]
TEXTS = [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(0, 90))) for _ in range(60)]
ODD = [None, "", " ", "\n\n", "a", "a b", "\x85\xa0x y z", "日本語 テキスト", "x" * 5000, "  a   b \n\n a   b ", "</s>[INST] ok [/INST]", "\\<\\", "# | #", "A a A a A a A a"]
ALL = TEXTS + ODD + TEXTS[:5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 4}", 0) for i, t in enumerate(ALL)] + [(None, "no id at all", None, None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `score` int")


def empty(df):
    return df.where("false")


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_language_id(spark, docs):
    rng = random.Random(1)

    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))

    rows = [(text("abcde"), "aa") for _ in range(60)] + [(text("stuvw"), "bb") for _ in range(60)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    got = language_id.predict(df, model, [F.col("doc_id")]).collect()
    assert sum(r.lang_pred == rows[r.doc_id][1] for r in got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.predict(docs, model, [F.col("doc_id")]).collect()}
    for i, t in enumerate(ALL):
        assert (odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
    nothing = language_id.train(empty(df))
    assert {r.lang_pred for r in language_id.predict(df, nothing, [F.col("doc_id")]).collect()} == {"und"}
    assert language_id.keep_identified(docs, model, 0.0).columns == docs.columns


def test_language_sample_survives_a_hot_text(spark):
    def share(text, label):
        (r,) = spark.createDataFrame([(text, label)], "text string, label string").select(F.shiftrightunsigned(F.xxhash64("text", "label"), 11) / float(1 << 53)).collect()
        return r[0]

    rare = [f"rare {i}" for i in range(10)]
    hot = next(t for t in (f"hot {i}" for i in range(1000)) if share(t, "aa") < 0.02)
    rows = [(hot, "aa")] * 400 + [(f"other {i}", "aa") for i in range(600)] + [(t, "bb") for t in rare * 2]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = language_id.training_sample(df, F.col("lang"), 40)
    assert {t for t, y in got if y == "bb"} == set(rare) and len(got) == len(set(got))
    assert got.count((hot, "aa")) == 1 and 5 <= sum(y == "aa" for _, y in got) <= 40
    assert sorted(got) == sorted(language_id.training_sample(df.repartition(3), F.col("lang"), 40))


def test_language_idf_counts_all_training_rows(spark):
    rows = [(f"{w} {i:b} w{i}x", "aa" if i % 2 else "bb") for i, w in enumerate(WORDS)] + [("12", "aa"), (None, "aa"), ("no label", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    texts = [t for t, y in rows if t and y and any(c.isalpha() for c in t)]
    seen = sum((language_id.term_counts(t) > 0).astype(int) for t in texts)
    model = language_id.train(df, max_train_rows=8)
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + seen)) + 1)


def test_language_counts_do_not_depend_on_chunks(monkeypatch):
    whole = language_id.term_counts("Ab c, dé" * 50)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert (language_id.term_counts("Ab c, dé" * 50) == whole).all()


def test_temperature():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    p = np.where(rng.random(4000) < 0.8, y, 1 - y)
    logits = np.log(0.8 / 0.2) * 3 * np.eye(2)[p]
    assert language_id.fit_temperature(logits, y) == pytest.approx(3, rel=0.15)


def test_toxicity(spark, docs, monkeypatch):
    rng = random.Random(2)

    def text(bad):
        w = [rng.choice(WORDS) for _ in range(60)]
        return " ".join(w[:30] + ["vilewretch"] * bad + w[30:])

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(160)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.col("doc_id") >= 40)
    got = {r.doc_id: r.score for r in toxicity.score(df, model, [F.col("doc_id")]).collect()}
    assert sum((got[i] >= 0.3) == bool(y) for i, _, y in rows[:40]) >= 38
    assert toxicity.score(docs, model, [F.col("doc_id")]).count() == docs.count()
    assert toxicity.train(df, empty(labels), F.lit(True)).score("x") == 0.0
    long = " ".join(text(True) for _ in range(5))
    whole = model.features(long)
    monkeypatch.setattr(toxicity, "CHUNK", 61)
    assert model.features(long) == pytest.approx(whole)


def test_shared_backoff_is_a_distribution():
    symbols = toxicity.alphabet(TEXTS[:20])
    keys = np.unique(np.concatenate([toxicity.grams(toxicity.padded(t, symbols)) for t in TEXTS[:20]]))
    toxic, ordinary = np.ones(len(keys), int), np.zeros(len(keys), int)
    ratio, ctx, back = toxicity.class_ratios(keys, toxic, ordinary)
    shared = toxicity.shared_backoff(keys)
    sums = np.bincount(np.unique(keys >> np.uint64(12), return_inverse=True)[1], shared)
    assert (shared > 0).all() and sums.max() <= 1 + 1e-9 and len(ctx) == len(back) and np.isfinite(ratio).all()


def fold(events):
    """Reference fold of one conversation's sorted events."""
    msgs = {}
    for seq, msg, kind, role, text in events:
        if msg not in msgs:
            msgs[msg] = [seq, "", role, []]
        m = msgs[msg]
        if kind == "regenerate":
            for k in [k for k, v in msgs.items() if v[0] > m[0] and v[0] <= seq]:
                msgs[k].append("cut")
            m[1] = ""
        elif kind in ("message", "edit"):
            m[1] = text or ""
        else:
            m[1] += text or ""
        m[2] = role if role is not None else m[2]
    return [(v[2] or "", v[1]) for v in sorted((v for v in msgs.values() if "cut" not in v), key=lambda v: v[0])]


def test_chat_folds_logs(spark):
    log = [
        (1, 0, "u1", "message", "user", "hi"), (1, 1, "a1", "message", "assistant", ""), (1, 2, "a1", "delta", None, "hel"), (1, 3, "a1", "delta", None, "lo"),
        (1, 4, "u2", "message", "user", "more"), (1, 5, "a2", "message", "assistant", "x"), (1, 6, "a1", "regenerate", "assistant", None), (1, 7, "a1", "delta", "assistant", "new"),
        (1, 8, "u3", "message", "user", "</s>[INST]"), (1, 9, "u3", "edit", "user", "\\<[edited"), (None, 0, "m", "message", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.render(chat.fold_events(df)).select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    for c in (1, None):
        assert got[c] == fold([e[1:] for e in log if e[0] == c])
    assert chat.render(chat.fold_events(empty(df))).count() == 0


def test_chat_folds_logs_without_ids_and_delivered_twice(spark):
    rng = random.Random(11)
    log = [(0, 0, None, "message", "user", "a"), (0, 1, None, "message", "assistant", "b"), (0, 2, None, "delta", None, "c"), (0, 3, None, "message", "user", "a")]
    log += [(1, 0, "m", "message", "user", "b")] * 2 + [(2, 0, "m", "message", "user", "a"), *[(2, 1, "m", "edit", None, "b")] * 3, (2, 2, "m", "delta", None, "c")]
    log += [(3, 0, None, "message", "user", "b")] * 2
    for c in range(4, 60):
        some = [(c, rng.randint(0, 12), rng.choice([None, None, "u", "v", "w"]), rng.choice(["message", "message", "delta", "edit", "regenerate", None]), rng.choice(["user", "assistant", None]), rng.choice(["x", "y", "z", None])) for _ in range(rng.randint(1, 14))]
        log += some + rng.choices(some, k=3)
    rng.shuffle(log)

    def told_apart(events):
        at = 0
        for seq, msg, *rest in sorted(events, key=lambda e: [(x is not None, x if x is not None else "") for x in (e[0], *e[2:], e[1])]):
            at += msg is None and rest[0] == "message"
            yield seq, at if msg is None else msg, *rest

    df = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string").repartition(5)
    got = {}
    for r in chat.fold_events(df).collect():
        got.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    assert [t for *_, t in sorted(got[0])] == ["a", "bc", "a"] and got[1] == [(0, "user", "b")] and got[2] == [(0, "user", "bc")] and len(got[3]) == 2
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.render(chat.fold_events(df)).select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    for c in {e[0] for e in log}:
        assert Counter(turns.get(c, [])) == Counter(fold(told_apart([e[1:] for e in log if e[0] == c])))


def test_chat_round_trip(spark):
    rows = [(1, i, RNG.choice(["user", "assistant", "<s>", None]), t) for i, t in enumerate(ODD)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.digest(chat.format_conversations(df)).collect()
    turns = sorted(rows, key=lambda x: (x[1], x[2] is not None, x[2] or ""))
    assert r.n_turns == len(rows)
    assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
    loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
    assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("shard_rows,block_rows", [(50, 3), (10_000, 10_000)])
def test_top_k(spark, shard_rows, block_rows):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)).round(2)
    v[100:180] = v[100]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(300)] + [(1000, None, 1), (1100, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (1200, [float("nan")] * 6, 1), (1300, [float("inf")] * 6, 1), (1400, [1.0], 1), (None, [1.0] * 6, 1), (7, [float(x) for x in v[7]], 0)]
    df = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    got = {}
    for r in vector_search.top_k(df, F.col("vec_id") % 100 == 0, 10, shard_rows, block_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(1024 * v).astype(int)
    ids = [*range(300), 7]
    want = {}
    for i in (0, 100, 200):
        best = sorted((-int(q[i] @ q[j]), j) for j in ids if j != i)[:10]
        want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {k: sorted(x) for k, x in got.items()} == want
    assert vector_search.top_k(empty(df), F.lit(True)).count() == 0


def test_quality_base(spark, docs):
    def brute(t):
        t = t or ""
        w = words_of(t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if words_of(line):
                again += line in seen
                seen.add(line)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = Counter(win)
        covered = {j for i, x in enumerate(win) if times[x] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered)

    field = line_quality.fit([])
    for r in line_quality.figures(docs, field, [F.col("doc_id")]).where("doc_id is not null").collect():
        want = brute(ALL[r.doc_id])
        assert tuple(r[n] for n in line_quality.BASE_FIELDS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert line_quality.keep_good(empty(docs), field).count() == 0


def test_viterbi_and_gradient():
    rng = np.random.default_rng(4)
    f = line_quality.LineField(rng.normal(size=line_quality.N_FEATURES), rng.normal(size=(2, 2)))
    x = rng.normal(size=(7, line_quality.N_FEATURES))
    unary = x @ f.emit

    def score(y):
        return sum(unary[i] * y[i] for i in range(7)) + sum(f.move[y[i], y[i + 1]] for i in range(6))

    paths = [[n >> i & 1 for i in range(7)] for n in range(128)]
    assert f.decode(x).tolist() == max(paths, key=score)
    y = np.array([paths[37]])
    value, ge, gm = line_quality.log_likelihood(f.emit, f.move, x[None], y, np.ones((1, 7), bool))
    assert value == pytest.approx(score(paths[37]) - np.log(sum(np.exp(score(p)) for p in paths)))
    for g, a, at in ((ge, f.emit, 3), (gm, f.move, (0, 1))):
        a[at] += 1e-5
        up = line_quality.log_likelihood(f.emit, f.move, x[None], y, np.ones((1, 7), bool))[0]
        a[at] -= 1e-5
        assert (up - value) / 1e-5 == pytest.approx(g[at], abs=1e-3)


def test_quality_learns():
    good = [" ".join(RNG.choice(WORDS) for _ in range(70)).encode() + b"." for _ in range(40)]
    bad = [b" ".join(w + b"%%%" for w in g.split()) for g in good]
    field = line_quality.fit([(g, 1) for g in good] + [(b, 0) for b in bad])
    assert all(field.judge(g)[-1] for g in good) and not any(field.judge(b)[-1] for b in bad)


def test_token_counts(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs, lambda: pieces.codec(PATH)))).cache()
    n = sorted(len(sp.encode(t or "")) + 1 for t in [*ALL, "no id at all", "no id at all"])
    for r in sums.collect():
        k = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_up_to) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(x <= k for x in n))
        assert r.truncated_total == sum(min(x, k) for x in n)
    for limit in (1, 2, 30, 77, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    assert token_counts.quantile(sums, 0.5) == n[(len(n) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(empty(docs), lambda: pieces.codec(PATH)))).count() == 0


def test_piece_codec():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    codec, own = piece_codec.PieceCodec(PATH), piece_codec.PieceCodec(PATH, library=False)
    texts = [t or "" for t in ALL] + ["".join(RNG.choice(" ab▁\né日<s>/x\x00") for _ in range(RNG.randint(0, 30))) for _ in range(400)]
    for t in texts:
        want = sp.encode(t)
        assert codec.encode(t) == own.encode(t) == want and codec.count(t) == len(want)
        assert codec.decode([*want, 2]) == sp.decode([*want, 2])
        raw = t.encode()
        spans = codec.spans(t)
        assert spans == own.spans(t)
        assert b"".join(raw[a:b] for _, a, b in spans) == raw
    for _ in range(500):
        ids = [RNG.choice([RNG.randrange(32000), RNG.randrange(0, 259)]) for _ in range(RNG.randint(0, 6))]
        assert codec.decode(ids) == sp.decode(ids)


def test_piece_codec_chunks(monkeypatch):
    codec = piece_codec.PieceCodec(PATH)
    want = [codec.encode(t or "") for t in ALL]
    monkeypatch.setattr(piece_codec, "CHUNK", 9)
    fresh = piece_codec.PieceCodec(PATH)
    assert [fresh.encode(t or "") for t in ALL] == want


def char_map(entries):
    """A compiled map from pairs, by a naive double-array builder."""
    texts, at = b"", {}
    for k, v in entries.items():
        at[k] = len(texts)
        texts += v + b"\0"
    units, used = {0: 0}, {0}

    def place(node, prefix):
        kids = sorted({k[len(prefix)] for k in entries if len(k) > len(prefix) and k.startswith(prefix)})
        leaf = prefix in entries
        base = 1
        while any((node ^ base ^ c) in used for c in [*kids, *([0] if leaf else [])]) or base >= 1 << 21:
            base += 1
        units[node] = units.get(node, 0) | base << 10 | (256 if leaf else 0)
        if leaf:
            units[node ^ base] = at[prefix] | 1 << 31
            used.add(node ^ base)
        for c in kids:
            used.add(node ^ base ^ c)
            units[node ^ base ^ c] = c
        for c in kids:
            place(node ^ base ^ c, prefix + bytes([c]))

    place(0, b"")
    flat = tuple(units.get(i, 0xFF) for i in range(max(units) + 1))
    return piece_codec.CharMap(flat, texts)


def test_longest_prefix_normalisation():
    m = piece_codec.PieceModel(char_map=char_map({b"a": b"x", b"ab": b"yz", b"\t": b" ", "é".encode(): b"e"}), strip_spaces=True, dummy_prefix=True)
    normal, origin = piece_codec.normalise(" aab\té  c ".encode(), m)
    assert normal.decode() == "▁xyz▁e▁c"
    assert origin.tolist() == [1, 1, 1, 1, 2, 2, 4, 4, 4, 5, 7, 7, 7, 9, 10]


def test_piece_digest(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in pieces.digest(docs, PATH, [F.col("doc_id")]).where("doc_id is not null").collect():
        ids = [*sp.encode(ALL[r.doc_id] or ""), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = pieces.decode(pieces.encode(docs, PATH, [F.col("doc_id")]), PATH, [F.col("doc_id")])
    assert {r.doc_id: r.text for r in back.collect()}[3] == ALL[3]


def test_pipeline_decodes_what_it_encodes(spark, docs):
    rows = corpus_pipeline.encode_pieces(spark, docs, "").collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(rows) == docs.count()
    for r in rows:
        text = (ALL[r.doc_id] if r.doc_id is not None else "no id at all") or ""
        assert r.ids == [*processor.encode(text), processor.eos_id()]
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(r.ids).encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("fan", [256, 3])
def test_lm(spark, docs, fan):
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    got = ngram_lm.score(docs, held, block_bytes=200, least_blocks=3, fan=fan).collect()
    texts = [(i, t) for i, t in enumerate(ALL)] + [(None, "no id at all")] * 2
    toks = {(i, t): [w.encode().lower() for w in words_of(t)] + [None] for i, t in texts}
    train = [toks[x] for x in texts if x[0] is None or x[0] % 5]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    assert len(got) == len(texts)
    for r in got:
        t = next(x for k, x in toks.items() if k[0] == r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(one[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    # with the same weights, the model's scores are those of plain counting
    before = [np.array([one[h] for h in [None, *t][:-1]]) for t in toks.values()]
    cells = Counter()
    for x in texts:
        if x[0] is None or x[0] % 5:
            t = toks[x]
            b, o, c = (np.array(a) for a in ([one[h] for h in [None, *t][:-1]], [one[w] for w in t], [two[p] for p in zip([None, *t], t)]))
            p2, p1, u = ngram_lm._estimates(b, o, c, n, v, 1)
            cells.update(((ngram_lm._bucket(b - 1) * ngram_lm.SIDE + ngram_lm._steps(p2, u)) * ngram_lm.SIDE + ngram_lm._steps(p1, u)).tolist())
    w = ngram_lm.learn_weights(sorted(cells.items()))
    assert np.allclose(w.sum(axis=1), 1)
    for (i, _), b in zip(toks, before):
        t = toks[i, ALL[i] if i is not None else "no id at all"]
        p2, p1, u = ngram_lm._estimates(b, np.array([one[x] for x in t]), np.array([two[p] for p in zip([None, *t], t)]), n, v, 0)
        k = w[ngram_lm._bucket(b)]
        r = next(r for r in got if r.doc_id == i)
        assert r.score == pytest.approx(np.log10(k[:, 0] * p2 + k[:, 1] * p1 + k[:, 2] * u).sum())
    assert ngram_lm.score(empty(docs), held).count() == 0


def brute_fingerprint(t):
    w = [x.encode().lower() for x in words_of(t)]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, docs, monkeypatch):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    fps = [brute_fingerprint(t) for t in ALL]
    cls = brute_classes(fps)
    for i in range(len(ALL)):
        assert got[i].fingerprint == f"{fps[i]:016x}"
        assert got[i].component_id == min(j for j in range(len(ALL)) if cls[j] == cls[i])
    kept = simhash.keep_one(docs)
    fp_none = brute_fingerprint("no id at all")
    assert kept.columns == docs.columns and kept.count() == len(set(brute_classes([*fps, fp_none])))
    assert simhash.near_duplicates(empty(docs)).count() == 0
    long = " ".join(TEXTS)
    want = simhash.fingerprint(long.encode())
    monkeypatch.setattr(simhash, "CHUNK", 10)
    assert simhash.fingerprint(long.encode()) == want == brute_fingerprint(long)


def test_simhash_tiles_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    near = base[:200].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    chain = np.array([(1 << n) - 1 for n in range(0, 64, 3)], np.uint64)
    fps = np.unique(np.concatenate([base, near, chain]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r.fp: r.root for r in simhash.components(simhash.links(df, tile=16)).collect()}
    cls = brute_classes([int(x) for x in fps])
    mine = [root.get(int(x), int(x)) for x in fps.view(np.int64)]
    pairs = {(a, b) for a, b in zip(cls, mine)}
    assert len(pairs) == len(set(cls)) == len(set(mine))


def test_targets():
    t = mixing.source_targets([("a", 100), ("b", 100), ("c", 100), (None, 0), ("d", 1000)])
    assert sum(t.values()) == Fraction(1300 * 3, 2) and t[None] == 0
    assert all(t[s] <= 2 * n for s, n in (("a", 100), ("b", 100), ("c", 100), ("d", 1000)))
    q = np.array([7, 0, 30, 5])
    split = np.zeros((5, 4), np.int64)
    for shard, of, n in mixing.split_quotas(q, 5, np.random.default_rng(0)):
        split[shard, of] = n
    assert (split.sum(axis=0) == q).all() and set(split.sum(axis=1)) <= {8, 9}


@pytest.mark.parametrize("block,broadcast", [(1 << 24, 200_000), (2, 0)])
def test_mixing(spark, docs, monkeypatch, block, broadcast):
    monkeypatch.setattr(mixing, "WORDS_A_BLOCK", block)
    monkeypatch.setattr(mixing, "BROADCAST_DRAWS", broadcast)
    rows = mixing.summary(docs).collect()
    size = Counter()
    taken = Counter()
    source = {i: None if i % 7 == 0 else f"s{i % 4}" for i in range(len(ALL))}
    for r in rows:
        if r.doc_id is not None:
            assert r.size == len(words_of(ALL[r.doc_id]))
        s = source.get(r.doc_id)
        size[s] += r.size
        taken[s] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    for r in rows:
        s = source.get(r.doc_id)
        assert r.source_size == size[s] and abs(taken[s] - r.target) <= 90
    assert sorted(rows, key=repr) == sorted(mixing.summary(docs.repartition(3)).collect(), key=repr)
    mixed = mixing.mix(docs, shards=4)
    want = Counter({r.doc_id: r.taken // r.size for r in rows if r.size and r.taken and r.doc_id is not None})
    got = Counter(r.doc_id for r in mixed.collect() if words_of(r.text) and r.doc_id is not None)
    assert mixed.columns == docs.columns and got == want
    # a partition a shard, of about equal numbers of draws
    parts = Counter(r.p for r in mixed.select(F.spark_partition_id().alias("p")).collect())
    assert mixed.rdd.getNumPartitions() == 4 and len(parts) == 4
    assert mixing.summary(empty(docs)).count() == 0
