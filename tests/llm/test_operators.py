"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from premia.llm import byte_bpe, jaccard, language, lattice, lines, packing, quality, substrings, vectors

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, bucket string, doc long, key string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _texts():
    rng = np.random.default_rng(3)
    vocab = np.array([f"w{i}" for i in range(400)] + ["the", "of", "É", "ß", "|", "naïve"])
    some = lambda n: " ".join(rng.choice(vocab, n))
    passage, base = some(60), rng.choice(vocab, 150)
    out = [None, "", " \n\t ", "one", "ONE", "a b c", "a b c d e", "x " * 300, "y", some(3000), "<|endoftext|> q", "日本 語 text", "a" * 3000]
    for k in range(14):
        out.append(f"{some(40)}\n{passage}\n{some(30)}\nsame line one\nsame line two\n\nend {k}")
        near = base.copy()
        near[rng.integers(0, 150, 2)] = "changed"
        out.append(" ".join(near))
        out.append(" ".join(base))
    return out


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k * 3, t, "en" if k % 2 else None, None, None, 1, "b", 5, "k") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_byte_bpe_round_trip(docs, empty, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    for r in both.collect():
        text = texts[r.doc_id // 3] or ""
        assert r.ids == own.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.bucket == "b"
    long = "word, and  more\n\n 12 " * 20000
    assert "".join(byte_bpe.cut(long, 1000)) == long
    assert [i for p in byte_bpe.cut(long, 1000) for i in own.encode_ordinary(p)] == own.encode_ordinary(long)
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def _by_match(own, text):
    """Ids of each match of the pattern, the matches found by another matcher."""
    import regex

    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in own._core_bpe.encode_single_piece(m[0].encode())]


def test_byte_bpe_of_white_space(spark):
    own = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(8)
    pool = ["a", "é", "7", "'", "'s", ".", "語", " ", "\n", "\t", "\u3000", "\x85", "\u2028", "\x1c"]
    cases = []
    for white in (" ", "\n", "\t", "\u3000", " \n", "\r\n"):
        for n in (1, 2, 4095, 4096, 4097, 9000):
            run = (white * n)[:n]
            cases += [run, f"a{run}", f"{run}b", f"a{run}b{run} 7{run}.", f"{run}'s{run}"]
    cases += ["".join(rng.choice(pool, 20000)) for _ in range(3)]
    for text in cases:
        assert [int(i) for p in byte_bpe.encode_one(own, text) for i in p] == _by_match(own, text)
    for text in ("".join(rng.choice(pool, 3000)) for _ in range(20)):
        assert "".join(byte_bpe.cut(text, 50)) == text
        assert [i for p in byte_bpe.cut(text, 50) for i in own.encode_ordinary(p)] == _by_match(own, text)
    long = [f"{side}{white * 2_000_000}{side}" for white in (" ", "\n", "\t", "\u3000") for side in ("", "x")]
    long += ["ab, cd " * 1_500_000, "語言文字" * 800_000, "é" * 1_000_000, "7" * 500_000]
    rows = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(8)
    encoded = byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN)
    both = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).select("doc_id", F.size("ids").alias("n"), F.sha2("decoded", 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in both} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(long)}
    assert {r.doc_id: r.n for r in both} == {k: len(_by_match(own, t)) for k, t in enumerate(long)}


def test_substrings_match_brute_force(docs, empty, texts, spark):
    seen, want = set(), {}
    for k, t in enumerate(texts):
        w = WORDS.findall(t or "")
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone |= set(range(i, i + 20))
            seen.add(key)
        want[k * 3] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    got = substrings.deduplicate(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want and len(got) == len(texts)
    assert substrings.deduplicate(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a " * 40), (1, "a " * 40), (1, "a " * 40)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.deduplicate(nameless).collect()) == [0, 39, 39]


def test_lines_match_brute_force(docs, empty, texts):
    for least in (2, 3):
        seen, want = set(), {}
        for k, t in enumerate(texts):
            all_ = t.split("\n") if t is not None else []
            own, gone = [i for i, x in enumerate(all_) if x.strip(" ")], set()
            for i in range(len(own) - least + 1):
                key = tuple(all_[j] for j in own[i : i + least])
                if key in seen:
                    gone |= set(own[i : i + least])
                seen.add(key)
            want[k * 3] = (len(all_), sorted(gone), None if t is None else "\n".join(x for i, x in enumerate(all_) if i not in gone))
        got = lines.deduplicate(docs, least=least).collect()
        assert {r.doc_id: (r.n_lines, r.removed, r.kept) for r in got} == want
    assert lines.deduplicate(empty).count() == 0


def test_jaccard_matches_brute_force(docs, empty, texts):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs).collect()}
    assert got == {k * 3: (len(s), root[k] * 3) for k, s in enumerate(sets)}
    assert jaccard.components_of(empty).count() == 0


def test_lattice_sums_over_segmentations(docs, empty, texts):
    vocab = lattice.vocabulary(PIECES)
    score = lattice.first_scores(vocab)
    place = {x: k for k, x in enumerate(vocab.names)}

    def brute(word):
        if not word:
            return 1.0
        return sum(math.exp(score[place[word[:n]]]) * brute(word[n:]) for n in range(1, len(word) + 1) if word[:n] in place)

    import pyarrow as pa

    found = ["the", "é", "w12", "x" * 200]
    got = lattice.word_scores(vocab, score, pa.array(found))
    for w, g in zip(found[:3], got, strict=False):
        assert abs(g - math.log(brute(lattice.MARK + w.encode()))) < 1e-9
    own = np.append(score, -np.inf)
    data = np.frombuffer(lattice.MARK + found[3].encode(), np.uint8)[None]
    assert abs(got[3] - lattice._forward(lattice._spans(vocab, data), 1, data.shape[1], own)[-1][0]) < 1e-6
    train = docs.where("doc_id % 2 = 0")
    model = lattice.fit(train, PIECES, rounds=1)
    c = collections.Counter()
    for k, t in enumerate(texts):
        if k * 3 % 2 == 0:
            c.update([*WORDS.findall((t or "").translate(LOW)), None])
    for r in lattice.score(docs, model).collect():
        w = [*WORDS.findall((texts[r.doc_id // 3] or "").translate(LOW)), None]
        base = sum(math.log10((c[x] + 1) / (sum(c.values()) + len(c) + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), sum(c.values()))
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9 and math.isfinite(r.score) and r.score < 0
    assert lattice.score(empty, lattice.fit(empty, PIECES, rounds=1)).count() == 0


def test_packing_is_a_partition_of_all_ids(docs, empty, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, got = Tokenizer.from_file(path), collections.defaultdict(list)
    pieces = packing.pack(docs, path, window=256).collect()
    for r in pieces:
        got[r.doc_id].append(r)
    for k, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(got[k * 3], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in parts]).tolist() == ids
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts[:-1]]]).tolist()
    fill = collections.defaultdict(list)
    for r in pieces:
        fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *[n for _, n in sorted(spans)][:-1]]).tolist()
    assert sorted(sum(n for _, n in s) for s in fill.values())[1:] == [256] * (len(fill) - 1)
    assert packing.pack(empty, path).count() == 0


def test_language_profiles(spark, empty):
    en, de = "the cat and the other thing that they have there", "der hund und die andere sache die sie nicht haben"
    rows = [(k, en if k % 2 else de, "en" if k % 2 else "de") for k in range(8)] + [(8, None, "en"), (9, "12 !", "de"), (10, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, profiles).collect()}
    assert [got[k][0] for k in range(11)] == ["de", "en"] * 4 + ["und"] * 3 and all(0 <= s <= 1 for _, s in got.values())
    assert got[9][1] == 0
    none = language.fit(empty)
    assert none.names == () and {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_quality_learns_and_scores_all(docs, empty, spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["plain", "words", "here", "and", "there", "some", "more"], 80)) + "." for _ in range(60)]
    bad = [" ".join(rng.choice(["@@##", "$$%%", "XX", "!!"], 80)) for _ in range(60)]
    train = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)] + [(0, 1), (3, 0), (500, None)], "doc_id long, quality int")
    model = quality.fit(quality.labelled(quality.features(train), labels))
    got = {r.doc_id: r.score for r in quality.score(quality.features(train), model).collect()}
    assert min(got[k] for k in range(60)) > 0.5 > max(got[k] for k in range(60, 120))
    every = quality.score(quality.features(docs), model).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    assert quality.fit(quality.labelled(quality.features(empty), labels)).constant == 0.5
    assert set(quality.keep(docs, model, 0.3).columns) == set(docs.columns)


def _vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x[50:60] = x[50] + rng.standard_normal((10, 16)) * 0.02
    x[70] = x[71]
    rows = [(k, v.tolist(), int(k % 3 if k < 40 else 0)) for k, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, x[50].tolist(), None), (305, [1.0, 2.0], 0), (306, [], 0)]
    return x, rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def test_near_vectors_match_brute_force(spark):
    x, rows, df = _vectors(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:300]])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(300, dtype=bool)
    got = {r.vec_id: r for r in vectors.near_duplicates(df, 0.98).collect()}
    assert [got[k].n_links for k in range(307)] == [*near.sum(axis=1).tolist(), *[0] * 7]
    assert all(got[k].component_id == 50 for k in range(50, 60)) and got[71].component_id == 70 and not got[71].kept and got[303].kept
    assert vectors.near_duplicates(df.where("false"), 0.98).count() == 0


def test_nearest_recall_and_scores(spark):
    x, _, df = _vectors(spark)
    got = collections.defaultdict(list)
    for r in vectors.nearest(df, "key % 20 = 0", k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 300, 20):
        product = x @ x[q]
        product[q] = -np.inf
        assert q not in dict(got[q]) and len(got[q]) == 5
        assert np.allclose([s for _, s in got[q]], [product[v] for v, _ in got[q]], rtol=1e-12)
        hits += len({v for v, _ in got[q]} & set(np.argsort(-product)[:5].tolist()))
    assert hits >= 0.9 * 5 * 15
    assert vectors.nearest(df.where("false"), "key % 20 = 0").count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= 200 and docs.select("doc_id").distinct().count() == docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.select("doc_id").distinct().count() == docs.count()
    assert last.where(F.col("offset") + F.col("length") > 4096).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == last.count()


def test_digests_are_of_the_texts(spark):
    from premia.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op8_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    for r in QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.001").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("copies", [20, 21, 30, 1000])
def test_copies_of_a_query_are_its_nearest(spark, copies):
    rng = np.random.default_rng(copies)
    x = rng.standard_normal((200 + copies, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = rng.permutation(len(x))[:copies]
    x[at] = x[at[0]]
    x = x.astype(float)
    # the scan drops no row that is as near as the last one kept
    for q in [at[0], *range(0, len(x), 50)]:
        turn = vectors.rotation(65, 0)
        top = np.sqrt((x * x).sum(axis=1).max())
        _, rows = vectors.scan(np.append(x[q], 0)[None] @ turn, vectors.lifted(x, top) @ turn, 21)
        product = (x * x[q]).sum(axis=1)
        if q in at:
            assert set(at.tolist()) <= set(rows.tolist())
        assert len(rows) >= 21
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    q = int(min(at))
    got = [r.vec_id for r in vectors.nearest(df, f"key = {q}").orderBy("rank").collect()]
    own = sorted(int(k) for k in at if k != q)
    assert got[: min(20, copies - 1)] == own[:20] and len(got) == 20


def test_queries_of_one_list_are_split(spark, monkeypatch):
    x, _, df = _vectors(spark)
    x[:200] = x[0]  # copies ask the same lists
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(map(tuple, vectors.nearest(df, "key % 2 = 0", k=5).collect()))
    monkeypatch.setattr(vectors, "ASK_ROWS", 16)
    monkeypatch.setattr(vectors, "LIST_ROWS", 64)
    groups = []

    def dealt(*sides, deal=vectors._dealt):
        groups.extend(out := deal(*sides))
        return out

    monkeypatch.setattr(vectors, "_dealt", dealt)
    again = sorted(map(tuple, vectors.nearest(df, "key % 2 = 0", k=5).collect()))
    assert [r[:3] for r in again] == [r[:3] for r in whole] and len(again) == 5 * 150
    rows, queries = (g.groupBy("list", "split", "part").count().agg(F.max("count")).first()[0] for g in groups)
    assert queries <= 2 * 16 and rows <= 2 * 64


def test_single_lines_that_are_long_or_whole_documents_go(spark, docs):
    long, other = " ".join(f"p{k}" for k in range(20)), " ".join(f"q{k}" for k in range(19))
    url = "https://x.example/" + "a" * 200
    rows = [f"a\n{long}\nb\n{other}\n{url}", f"c\n\n{long}\nd", f"e\n{other}\nf\n{url}\n{url}", "one line", "g\none line\nh", "one line", " \none line\n", long, None, f"i\n{long}  "]
    # 40 characters, but no 20 words
    rows += ["j\n" + "long-words " * 5, "k\n" + "long-words " * 5, "l\n" + "w " * 12 + " " * 40, "m\n" + "w " * 12 + " " * 40]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.removed for r in lines.deduplicate(df, alone=20).collect()}
    assert {k: v for k, v in got.items() if v} == {1: [2], 2: [3, 4], 5: [0], 6: [1], 7: [0]} and len(got) == len(rows)
    runs = {r.doc_id: set(r.removed) for r in lines.deduplicate(docs).collect()}
    both = {r.doc_id: set(r.removed) for r in lines.deduplicate(docs, alone=20).collect()}
    assert all(runs[k] <= both[k] for k in runs) and sum(map(len, both.values())) > sum(map(len, runs.values()))
    folder = "/root/testdata/sf0.01"
    found = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).where("text <> ''")
    assert found.where("text NOT LIKE '%\n%'").groupBy("text").count().where("count > 1").count() == 0


def test_long_words_have_the_lattice_of_short_ones(monkeypatch):
    import pyarrow as pa

    vocab = lattice.vocabulary(PIECES)
    score = lattice.first_scores(vocab)
    rng = np.random.default_rng(2)
    found = ["".join(rng.choice(["the", "ing", "日本", "語", "x", "://", "é", "w1"], n)) for n in (1, 5, 60, 61, 150, 200)]
    found += ["a" * 300, "https://example.org/" + "path/" * 60, "日本語" * 40, "the", ""]
    count = np.arange(1, len(found) + 1)
    text = pa.array(found)
    short, scores = lattice.expected(vocab, score, text[:2], count[:2]), lattice.word_scores(vocab, score, text)
    banded = lattice.expected(vocab, score, text, count)
    monkeypatch.setattr(lattice, "LONG", 1 << 20)  # all words by the path of short ones
    assert np.allclose(scores, lattice.word_scores(vocab, score, text), rtol=1e-9)
    assert np.allclose(banded, lattice.expected(vocab, score, text, count), rtol=1e-6, atol=1e-9)
    monkeypatch.setattr(lattice, "LONG", 0)  # all by bands, and bands of one or few positions
    for places in (1, 7 * vocab.longest, 1 << 19):
        monkeypatch.setattr(lattice, "_BAND", places)
        assert np.allclose(lattice.expected(vocab, score, text, count), banded, rtol=1e-6, atol=1e-9)
        assert np.allclose(lattice.expected(vocab, score, text[:2], count[:2]), short, rtol=1e-6, atol=1e-9)
        assert np.allclose(lattice.word_scores(vocab, score, text), scores, rtol=1e-9)
    size = np.array([len(x) for x in vocab.names])
    want = sum(c * len((lattice.MARK + w.encode())) for c, w in zip(count, found, strict=True))
    assert abs((banded * size).sum() - want) < 1e-6 * want


def test_letters_of_all_planes(spark):
    import pyarrow as pa

    ja, zh, runes = "これは日本の言葉です 私は学生です", "这是中国的语言 我是学生", "𐌰𐌱𐌲 𐌳𐌴𐌰"
    rows = [(0, ja, "ja"), (1, zh, "zh"), (2, runes, "got"), (3, "😀 😃🎉", None), (4, "私は日本です", None), (5, "我是中国语言", None), (6, "𐌰𐌱𐌲", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, language.fit(df)).collect()}
    assert [got[k][0] for k in range(7)] == ["ja", "zh", "got", "und", "ja", "zh", "got"] and got[3][1] == 0
    # letters that are 67 apart are two; n-grams are of code points
    row, code, n = language.grams(pa.array(["一" + chr(0x4E00 + 67) + "一", "", "b"], pa.large_string()))
    one, two = 0x4E00, 0x4E00 + 67
    want = collections.Counter()
    line = [1, one, two, one]
    for size in (1, 2, 3):
        for k in range(len(line) - size + 1):
            if line[k : k + size] != [1]:
                want[sum(x << (21 * (size - 1 - j)) for j, x in enumerate(line[k : k + size]))] += 1
    assert dict(zip(code[row == 0].tolist(), n[row == 0].tolist(), strict=True)) == want and 1 not in row and 2 in row


def test_words_by_parts_have_the_tokenizers_ids():
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    pool = ["<|endoftext|>", "<|", "|>"] + list("ab'É語　\x0b\x1cé9.,! \U0001f600\u0301İΣ½Ⅷ٣_-&$ßŉбЁ\u0958") + ["'s", "'re"]
    words = sorted({"".join(rng.choice(pool, rng.integers(1, 9))) for _ in range(20000)})
    for half in (words[::2], words):  # the second time half of the parts are remembered
        ids, at, count = packing.word_ids(path, pa.array(half, pa.large_string()))
        for w, a, n in zip(half, at, count, strict=True):
            assert ids[a : a + n].tolist() == own.encode(w, add_special_tokens=False).ids, w


def test_stages_keep_columns_that_operators_use(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(k, f"{passage}\nown line {k} of its own\n{passage}", "mine", [k], 7, "d", "s", "x", k) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, removed array<int>, n_removed int, _doc string, _shared string, document string, n_words int")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.substring_dedup):
        found = stage(spark, docs, "")
        assert found.schema == docs.schema
        texts = set()
        for r in found.collect():
            assert tuple(r)[2:] == rows[r.doc_id][2:]
            texts.add(r.text)
        assert len(texts) > 1  # the stage did its work
