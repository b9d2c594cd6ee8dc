"""Every dealt operator against brute force, and on nulls, empty and repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from lossledger.llm import (
    decontaminate,
    language,
    maxent,
    neardup,
    packing,
    preferences,
    quality,
    substrings,
    token_counts,
    toxicity,
)
from lossledger.llm.common import hashed, id_remainder, mixed, word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_words int, g int"
WORDBPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    """Small vocabulary, shared passages, near copies, junk and edge cases."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["The", "the", "of", "été", "ß"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    base = [rng.choice(words) for _ in range(120)]
    out = [None, "", " \n\t ", "one", "two words", "a " * 90, "a b  c\n\nA b", passage, passage]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    for _ in range(25):
        body = [rng.choice(words) for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.4:
            at = rng.randrange(len(body))
            body[at:at] = passage.split()[rng.randrange(40):][: rng.randrange(10, 70)]
        out.append(" ".join(body).replace(" w7 ", "\n"))
    out.append(" ".join(rng.choice(words) for _ in range(6000)))
    return out


@pytest.fixture(scope="module")
def rows():
    own = [(k, t, "en", None, None, "x", 1, 2) for k, t in enumerate(texts())]
    return [*own, (20, own[20][1], None, "s", 3, None, None, None), (None, own[30][1], "en", "s", 3, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_token_counts(docs, rows, nothing):
    vocabulary = token_counts.vocabulary(PIECES)
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, True))
    marked = token_counts.counter(PIECES).marked
    want = [(r[0], len(whole.encode(marked(r[1] or "")).ids) if r[1] else 0) for r in rows]
    assert ordered(token_counts.counted(docs, PIECES).select("doc_id", "n_tokens")) == sorted(want, key=repr)
    assert token_counts.counted(nothing, PIECES).count() == 0


def test_token_counts_unknown_pieces_fuse():
    small = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0)])
    assert small.search("▁aa") == (-3.0, 2)  # a tie: the earlier begin wins
    assert small.search("▁xya")[1] == 3


def benchmark(spark):
    passage = texts()[7].split()
    return spark.createDataFrame(
        [(1, " ".join(passage[5:40])), (1, " ".join(passage[5:40])), (2, "TWO words"), (3, None), (4, "..."), (None, "one"),
         (10, " ".join(passage[:13]).upper()), (11, "a a a")], "item_id bigint, text string")


def test_decontamination(spark, docs, rows, nothing):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = defaultdict(set)
    for r in benchmark(spark).collect():
        w = re.findall(pattern, low(r["text"]))
        if w and r["item_id"] is not None:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(str(r["item_id"]))
    want = []
    for r in rows:
        w = re.findall(pattern, low(r[1]))
        hit, items = set(), set()
        for window, own in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    items |= own
        want.append((r[0], len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    found = decontaminate.marked(docs, benchmark(spark)).select(
        "doc_id", f"{decontaminate.DECISION}n_words", decontaminate.hit_words(), F.sort_array(f"{decontaminate.DECISION}items"), decontaminate.contaminated())
    assert ordered(found) == sorted(want, key=repr)
    kept = decontaminate.clean(docs, benchmark(spark))
    assert kept.columns == docs.columns
    assert kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.clean(docs, benchmark(spark).limit(0)).count() == len(rows)
    assert decontaminate.marked(nothing, benchmark(spark)).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    whole = ordered(decontaminate.marked(docs, benchmark(spark)).select("doc_id", decontaminate.hit_words()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 600)
    assert ordered(decontaminate.marked(docs, benchmark(spark)).select("doc_id", decontaminate.hit_words())) == whole


def test_a_window_that_very_many_items_share(spark, docs, monkeypatch):
    """200 items of one text next to the others: their ids alone exceed a block."""
    shared = benchmark(spark).filter("text IS NOT NULL").first()["text"]
    more = spark.createDataFrame([(10_000 + k, shared) for k in range(200)], benchmark(spark).select("item_id", "text").schema)
    items = benchmark(spark).select("item_id", "text").unionByName(more)
    columns = ["doc_id", f"{decontaminate.DECISION}spans", F.sort_array(f"{decontaminate.DECISION}items")]
    whole = ordered(decontaminate.marked(docs, items).select(*columns))
    assert max(len(r[2]) for r in whole) > 200
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    windows = decontaminate.benchmark_windows(items, 13)
    assert windows.agg(F.max(F.size("items"))).first()[0] < 100 and windows.groupBy("window").count().filter("count > 1").count() > 0
    assert ordered(decontaminate.marked(docs, items).select(*columns)) == whole


def kept_words(rows):
    """Windows of 20 words that stand earlier, judged on (id, text) once per different row."""
    seen, out = {}, {}
    for i, t in sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = split(t)
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone |= set(range(k, k + 20))
        out[i, t] = [x for k, x in enumerate(w) if k not in gone]
    return out


@pytest.mark.parametrize("frequent", [0.01, 1e-9])
def test_substring_dedup(docs, rows, nothing, monkeypatch, frequent):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    own = [r for r in rows if r[0] is not None]
    mine = docs.filter("doc_id IS NOT NULL")
    kept = kept_words(own)
    want = []
    for r in own:
        words = kept[r[0], r[1] or ""]
        want.append((r[0], len(split(r[1])), len(split(r[1])) - len(words), hashlib.sha256(" ".join(words).encode()).hexdigest()))
    assert ordered(substrings.digests(mine)) == sorted(want, key=repr)
    left = substrings.without_repeats(mine)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], split(r["text"])) for r in left.collect()) == sorted(
        (r[0], kept[r[0], r[1] or ""]) for r in own if kept[r[0], r[1] or ""] or not split(r[1]))
    assert substrings.digests(docs).count() == len(rows)
    assert substrings.digests(nothing).count() == 0


def shingles(text, width):
    w = split(low(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_near_duplicates(docs, rows, nothing, monkeypatch):
    for block in (1024, 2):
        monkeypatch.setattr(neardup, "BLOCK", block)
        sets = {r[0]: shingles(r[1], 3) for r in rows if r[0] is not None}
        root = {i: i for i in sets}

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                    x, y = top(i), top(j)
                    root[max(x, y)] = min(x, y)
        want = [(r[0], len(shingles(r[1], 3)), None if r[0] is None else top(r[0])) for r in rows]
        assert len({w[2] for w in want}) < len(sets) - 5
        assert ordered(neardup.groups(docs.select("doc_id", "text"))) == sorted(want, key=repr)
    kept = neardup.one_per_group(docs, 3, 85)
    assert kept.columns == docs.columns
    assert kept.count() == sum(w[0] == w[2] for w in want)
    assert neardup.groups(nothing.select("doc_id", "text")).count() == 0


def test_signature_estimates():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (900, 50, 50))
    _, packed = neardup.signatures([np.concatenate([common, a]), np.concatenate([common, b])])
    assert abs(neardup.similarity(packed[:1], packed[1:])[0, 0] - 0.9) < 0.08


def test_packing(docs, rows, nothing):
    tokenizer = Tokenizer.from_file(WORDBPE)
    found = packing.packed(docs, WORDBPE, 64, with_ids=True).toPandas()
    want = []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0], k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    got = [(None if i != i else int(i), *map(int, x)) for i, *x in found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 64
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    assert packing.packed(nothing, WORDBPE, 64).count() == 0


def test_configurations_hold_every_piece_in_few_sequences():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.gamma(2, 90, 60_000).astype(int), 1, 512), minlength=513)
    used = packing.configurations(counts, 512)
    held = np.zeros(513, np.int64)
    for configuration, often in used.items():
        assert sum(x * n for x, n in configuration) <= 512
        for x, n in configuration:
            held[x] += n * often
    assert (held == counts).all()
    assert sum(used.values()) <= sum(packing.best_fit(counts, 512).values())


def test_quality_measures(docs, rows, nothing):
    measures = quality.measured(docs)
    found = measures.select("doc_id", *(F.col(f"{quality.MEASURES}.{c}") for c in ("n_words", "word_chars", "symbol", "n_dup_lines", "n_repeat_words")))
    want = []
    for r in rows:
        w, text = split(r[1]), r[1] or ""
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if split(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)))
    assert ordered(found) == sorted(want, key=repr)
    passing = quality.passing(docs)
    assert passing.columns == docs.columns
    assert quality.passing(nothing).count() == 0


def shuffled_bytes(spark):
    """Bytes that all stages of the session have written for others so far."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_jensen_shannon(spark):
    frame = spark.range(1).select(F.array(F.lit(3), F.lit(1), F.lit(0)).cast("array<bigint>").alias("c"), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)).alias("q"))
    p, q = np.array([0.75, 0.25, 0]), np.array([0.5, 0.25, 0.25])
    m = (p + q) / 2
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    assert frame.select(quality.jensen_shannon(F.col("c"), F.col("q"))).first()[0] == pytest.approx(np.sqrt((part(p) + part(q)) / 2))


def test_language_model_base_and_sum(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 40)  # most words go the way of the join
    held = id_remainder("doc_id", 7) == 2
    counts = Counter()
    for r in rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            counts.update([*split(low(r[1])), " "])
    total, different = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        w = [*split(low(r[1])), " "]
        want.append((r[0], len(w), sum(counts[x] > 0 for x in w), total, round(sum(log10((counts[x] + 1) / (total + different + 1)) for x in w), 6)))
    found = maxent.scores(docs, ~held, held)
    assert ordered(found.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))) == sorted(want, key=repr)
    assert found.filter("score > 0 OR score IS NULL").count() == 0
    assert found.agg(F.sum("score") > F.sum("base_score")).first()[0]
    assert maxent.scores(nothing, ~held, held).count() == 0


def test_language_model_learns_every_context(spark, monkeypatch):
    # Far more pairs than there are words in any fixed list, and every one tells its second word.
    pairs = [(k, f"a{k} b{k * 7 % 400}") for k in range(400)]
    kept = [(1000 * n + k, t) for n in range(4) for k, t in pairs]
    asked = [(-1 - k, t) for k, t in pairs] + [(-1001 - k, f"a{k} b{(k * 7 + 1) % 400}") for k, _ in pairs]
    for head in (200_000, 40):  # words in the tree, and words below its last leaf
        monkeypatch.setattr(maxent, "HEAD", head)
        monkeypatch.setattr(maxent, "PART", 500)
        both = spark.createDataFrame(kept + asked, "doc_id bigint, text string").repartition(3)
        found = {r["doc_id"]: r["score"] for r in maxent.scores(both, F.col("doc_id") >= 0, F.col("doc_id") < 0).collect()}
        assert len(found) == len(kept + asked)
        gain = [found[-1 - k] - found[-1001 - k] for k, _ in pairs]
        assert min(gain) > 0
        assert np.mean(gain) > 1
        # The right second word is nearly sure: what is left is the first of 400 words.
        assert np.mean([found[-1 - k] for k, _ in pairs]) > -3.6


def dense(events, vocab, words):
    """The model with a weight for every word: class and word probabilities of all contexts, in plain loops."""
    runs, pairs = sorted({o for o, _, _ in events}), sorted({(o, t) for o, t, _ in events})
    run = np.array([runs.index(o) for o, _ in pairs])
    skip = np.array([t if 0 <= t < maxent.ROWS // 2 else maxent.ROWS // 2 + int(mixed(np.array([t]).view(np.uint64))[0]) % (maxent.ROWS // 2) for _, t in pairs])
    row = np.minimum(np.arange(words), vocab.size)
    n = np.zeros((len(pairs), words))
    for (o, t, w), k in events.items():
        n[pairs.index((o, t)), w] = k
    belongs = np.eye(vocab.classes)[vocab.of[row]]
    by_class, add = n @ belongs, np.eye(len(runs))[run].T
    shared, r = np.zeros((maxent.ROWS, vocab.classes)), maxent.RIDGES

    def step(w, o, e, ridge):
        return np.clip(w + np.clip(maxent.RATE * (o - e - ridge * w) / (e + ridge), -maxent.MOVE, maxent.MOVE), -maxent.HIGHEST, maxent.HIGHEST)

    def classes(steps):
        one, two = np.zeros((len(runs), vocab.classes)), np.zeros_like(by_class)
        for k in range(steps + 1):
            p = np.exp(vocab.prior + shared[skip] + one[run] + two)
            p /= p.sum(1, keepdims=True)
            e = by_class.sum(1, keepdims=True) * p
            if k < steps:
                one, two = step(one, add @ by_class, add @ e, r[0]), step(two, by_class, e, r[1])
        return p

    for k in range(maxent.ROUNDS):
        e, onto = by_class.sum(1, keepdims=True) * classes(k), np.eye(maxent.ROWS)[skip].T
        shared = step(shared, onto @ by_class, onto @ e, r[2])
    one, two = np.zeros((len(runs), words)), np.zeros_like(n)
    for k in range(maxent.STEPS + 1):
        q = vocab.share[row] * np.exp(one[run] + two)
        q /= (q @ belongs) @ belongs.T
        e = (by_class @ belongs.T) * q
        if k < maxent.STEPS:
            one, two = (np.where(o > 0, step(w, o, x, y), 0) for w, o, x, y in ((one, add @ n, add @ e, r[3]), (two, n, e, r[4])))
    p = classes(maxent.STEPS) @ belongs.T * q
    return {(o, t, w): p[k, w] for k, (o, t) in enumerate(pairs) for w in range(words)}


def test_language_model_against_dense_weights(docs, rows, monkeypatch):
    monkeypatch.setattr(maxent, "PART", 700)  # several parts
    for head in (30, 1000):
        monkeypatch.setattr(maxent, "HEAD", head)
        held = id_remainder("doc_id", 7) == 2
        texts_ = [([*(w.encode() for w in split(low(x[1]))), b" "], zlib.crc32(("" if x[0] is None else str(x[0])).encode()) % 7 != 2) for x in rows]
        n = Counter(w for t, training in texts_ for w in t if training)
        vocab = maxent.vocabulary(docs.sparkSession.createDataFrame(list(n.items()), "word binary, n bigint"))
        number = word_hashes()
        ids = [vocab.ids(hashed(t, number)) for t, _ in texts_]
        events = Counter()
        for own, (_, training) in zip(ids, texts_, strict=True):
            for o, t, w in zip([-1, *own], [-1, -1, *own], vocab.targets(own), strict=False):
                events[int(o), int(t), int(w)] += training
        p = dense(events, vocab, vocab.size + (1 << vocab.digits))
        for o, t in {(o, t) for o, t, _ in events}:
            assert sum(p[o, t, w] for w in range(vocab.size + (1 << vocab.digits))) == pytest.approx(1)
        seen = [(w, c, vocab.targets(vocab.ids(hashed([w], number)))[0]) for w, c in n.items()]
        size = Counter()
        for _, c, leaf in seen:
            size[leaf] += c + 1
        want = []
        for x, own, (t, _) in zip(rows, ids, texts_, strict=True):
            total = 0.0
            for o, u, w, word in zip([-1, *own], [-1, -1, *own], vocab.targets(own), t, strict=False):
                total += log10(p[int(o), int(u), int(w)]) + (log10((n[word] + 1) / (size[w] + 1)) if w >= vocab.size else 0)
            want.append((-1 if x[0] is None else x[0], total))
        found = [(-1 if x["doc_id"] is None else x["doc_id"], x["score"]) for x in maxent.scores(docs, ~held, held).collect()]
        for (a, x), (b, y) in zip(sorted(want), sorted(found), strict=True):
            assert a == b and x == pytest.approx(y, rel=2e-4, abs=1e-4)


def test_language_model_moves_little(spark, monkeypatch):
    """Words without a class move once, log probabilities in three bytes."""
    monkeypatch.setattr(maxent, "HEAD", 50)
    rng = random.Random(6)
    own = [(i, " ".join(f"w{int(rng.paretovariate(0.3)) % 30_000}" for _ in range(400))) for i in range(500)]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(4).localCheckpoint()
    held = id_remainder("doc_id", 7) == 2
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on large tables
    try:
        before = shuffled_bytes(spark)
        assert maxent.scores(docs, ~held, held).collect()
        moved = (shuffled_bytes(spark) - before) / sum(len(t) for _, t in own)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert moved < 4.7  # 5.09 with words joined twice and log probabilities as floats


def test_packed_numbers():
    for x in (np.array([], np.int32), np.arange(-3, 9, dtype=np.int32), np.array([1.5, -2.25], np.float32), np.array([7], np.uint8)):
        assert maxent.unpacked(maxent.packed(x), x.dtype).tolist() == x.tolist()


def test_language_identification(spark, docs, nothing):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    held = id_remainder("doc_id", 4) == 2
    models_ = language.trained(real, ~held)
    found = language.identified(real, models_).join(real, "doc_id").filter(held)
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()
    edge = language.identified(docs, models_).join(docs, ["doc_id"])
    assert edge.filter("text IS NULL OR trim(text) = ''").select("lang_pred", "score").distinct().collect() in ([], [("und", 0.0)])
    assert language.identified(docs, language.trained(nothing, F.lit(True))).select("lang_pred").distinct().collect() == [("und",)]
    assert language.identified(nothing, models_).count() == 0


def test_character_models_sum_to_less_than_one():
    model = language.Model(["abab", "abba", "ca"], np.array([5, 2, 1]))
    one_char = [chr(c) for c in range(97, 100)]
    word, hashes, place = language._grams(one_char)
    assert np.exp(-model.costs(word, hashes, place, 3)).sum() < 1


def test_toxicity(spark, docs, nothing):
    # The smaller tables have too few toxic labels (45) to learn their words from.
    real = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    network = toxicity.fitted(real, labels, id_remainder("doc_id", 5) != 0)
    held_out = labels.filter(id_remainder("doc_id", 5) == 0)
    found = toxicity.scored(real, network).join(held_out, "doc_id").toPandas()
    toxic, clean = found[found.toxic == 1].score, found[found.toxic == 0].score
    assert (toxic.to_numpy()[:, None] > clean.to_numpy()[None, :]).mean() > 0.9
    edge = toxicity.scored(docs, network)
    assert edge.count() == docs.count()
    assert edge.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.scored(docs, toxicity.fitted(docs, labels.limit(0), F.lit(True))).select("score").distinct().collect() == [(0.0,)]
    assert toxicity.scored(nothing, network).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Twenty parts; each odd word stands in four toxic texts only, whatever their number."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 200, raising=False)
    n = 6_000
    rows = [(i, f"common words w{i // 8} and more", i % 2) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    taught = toxicity.taught(docs, labels, F.lit(True))
    assert taught.count() == n and 0 < taught.filter("back").count() < n / 2
    network = toxicity.fitted(docs, labels, F.lit(True))
    own = {r[0] for r in taught.filter("NOT back").select("doc_id").collect()}
    heard = {i // 8 for i in own if sum(k in own for k in range(i // 8 * 8, i // 8 * 8 + 8)) >= toxicity.EVIDENCE}
    buckets = {toxicity._numbers(f"w{k}".encode()) & 0xFFFFFF for k in heard}
    assert network.learned[0, sorted(buckets)].all() and len(heard) > 600
    again = toxicity.fitted(docs.repartition(3), labels, F.lit(True))
    assert (network.embedding == again.embedding).all() and (network.layers() == again.layers()).all()


def test_toxicity_moves_no_text_without_label(spark, monkeypatch):
    rng = random.Random(5)
    own = [(i, " ".join(f"w{rng.getrandbits(60)}" for _ in range(500))) for i in range(1000)]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(4).localCheckpoint()
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 1000, 20)], "doc_id long, quality int, toxic int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # labels as they are on large tables
    try:
        before = shuffled_bytes(spark)
        assert toxicity.taught(docs, labels, F.lit(True)).count() == 50
        assert shuffled_bytes(spark) - before < sum(len(t) for _, t in own) / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Where every bit is set, the labels themselves decide.
    want = {tuple(r) for r in toxicity.taught(docs, labels, F.lit(True)).collect()}
    monkeypatch.setattr(toxicity, "BITS", 64)
    assert {tuple(r) for r in toxicity.taught(docs, labels, F.lit(True)).collect()} == want and len(want) == 50


def test_preferences(spark):
    turns = [(1, 0, "user", "Q"), (1, 1, "assistant", "yes"), (2, 0, "user", "Q"), (2, 1, "assistant", "no"), (2, 2, "user", "why"),
             (4, 5, None, None), (4, 7, "assistant", "yes"), (5, 0, "assistant", "yes"), (None, 0, "user", "x"), (9, 0, "user", "alone")]
    lists = preferences.turn_lists(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    own = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in lists.collect()}
    assert own[4] == [("", ""), ("assistant", "yes")]
    pairs = [(1, own[1], own[2]), (2, own[1], own[1]), (3, own[4], own[5]), (4, own[2][:1], own[2])]
    kind = "array<struct<role:string,text:string>>"
    found = {r["pair_id"]: r for r in preferences.formatted(spark.createDataFrame(pairs, f"pair_id bigint, chosen {kind}, rejected {kind}")).collect()}
    assert found[1]["prompt"] == "<|user|>\nQ\n"
    assert found[1]["chosen_text"] == "<|assistant|>\nyes\n"
    assert found[1]["rejected_text"] == "<|assistant|>\nno\n<|user|>\nwhy\n"
    for side in ("chosen", "rejected"):
        for r in found.values():
            for span in r[f"{side}_mask"]:
                assert r[f"{side}_text"][span["begin"] : span["end"]] in ("yes", "no")
    assert found[1]["usable"]
    assert (found[2]["prefix_turns"], found[2]["chosen_text"], found[2]["usable"]) == (2, "", False)
    assert found[3]["prefix_turns"] == 0
    assert (found[4]["prefix_turns"], found[4]["chosen_text"]) == (1, "")
    assert preferences.neighbour_pairs(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_whole_conversations(spark):
    # Sparse ids, none beside another; no answer, turns after the last answer, no id.
    turns = [(10, 0, "user", "Q"), (10, 1, "assistant", "yes"), (10, 2, "user", "thanks"), (30, 0, "user", "Q"), (30, 1, "assistant", "no"),
             (30, 2, "user", "why"), (70, 0, "user", "alone"), (None, 0, "assistant", "x")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    found = {r["pair_id"]: r for r in preferences.formatted(preferences.whole_pairs(spark.createDataFrame(turns, schema))).collect()}
    assert set(found) == {10, 30, 70, None}
    assert (found[10]["prefix_turns"], found[10]["prompt"]) == (1, "<|user|>\nQ\n")
    assert found[10]["chosen_text"] == "<|assistant|>\nyes\n<|user|>\nthanks\n"
    assert found[10]["rejected_text"] == "<|assistant|>\nno\n<|user|>\nwhy\n"
    assert {k: r["usable"] for k, r in found.items()} == {10: True, 30: False, 70: False, None: True}
    assert found[70]["rejected_text"] == "<|assistant|>\nx\n"
    # Every conversation is chosen once and rejected once, over any number of ranges, and all turns are there.
    real = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").withColumn("conv_id", F.col("conv_id") * 5)
    pairs = preferences.whole_pairs(real)
    assert pairs.count() == pairs.select("pair_id").distinct().count() == real.select("conv_id").distinct().count()
    assert tuple(pairs.agg(F.sum(F.size("chosen")), F.sum(F.size("rejected"))).first()) == (real.count(), real.count())
    one = preferences.formatted(preferences.whole_pairs(real.filter("conv_id = 5"))).collect()
    assert [(r["pair_id"], r["rejected_text"], r["usable"]) for r in one] == [(5, "", False)]
    assert preferences.whole_pairs(real.limit(0)).count() == 0
