"""Long texts, clashing names, repeated ids, ties and empty tables; stages of the pipeline and the toxicity fit against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import groups

import corpus_pipeline
from pulsegrid.llm import bpe, common, fingerprints, idfiles, langid, near_dup, packing, quality, secrets, tokens, toxicity, warc
from pulsegrid.llm.queries import vocabulary

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def clashing(spark):
    """Names that the operators use inside, and one with a dot."""
    names = ["_q_n", "_v_length", "_n", "_part", "row", "part", "queue", "lane", "ids", "key", "rep", "class", "component", "kept", "x.y"]
    rows = [(i, f"word number {i} is here and so on " * 12 + "end.", "en", "a", 400, *["x"] * len(names)) for i in range(6)]
    rows += [(7, rows[0][1], "en", None, 400, *["x"] * len(names)), (8, None, None, None, None, *[None] * len(names))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))


def test_clashing_columns(clashing):
    profiles = langid.fit(clashing)
    for out in (quality.passing(clashing), near_dup.one_of_each(clashing), secrets.redact(clashing), langid.identified(clashing, profiles)):
        assert out.columns == clashing.columns
        assert {tuple(r)[5:] for r in out.collect()} <= {("x",) * 15, (None,) * 15}
    assert near_dup.one_of_each(clashing).filter("doc_id = 7").count() == 0
    assert packing.pack(clashing, vocabulary(BYTE)).select("doc_id").distinct().count() == 8
    for made in (toxicity.scores(clashing, toxicity.Lexicon()), fingerprints.with_edits(clashing), near_dup.near_duplicates(clashing), secrets.scan(clashing), langid.predict(clashing, profiles)):
        assert made.count() == 8


@pytest.fixture(scope="module")
def long_texts(spark):
    """A word of a megabyte, a text of 200,000 words, and a text of one line of signs."""
    rng = random.Random(2)
    blob = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    words = " ".join(f"w{rng.randrange(30_000)}" for _ in range(200_000))
    return spark.createDataFrame([(1, blob, "en", "a"), (2, words, "en", "b"), (3, "#" * 300_000, None, None), (4, words, "en", "c")], "doc_id long, text string, lang string, source string")


def test_long_texts(long_texts):
    from tokenizers import Tokenizer

    texts = {r["doc_id"]: r["text"] for r in long_texts.collect()}
    lib = {n: Tokenizer.from_file(vocabulary(n)) for n in (BYTE, WORD)}
    for r in bpe.encode_decode(long_texts, vocabulary(WORD)).collect():
        want = lib[WORD].encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == lib[WORD].decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in idfiles.write_and_read(long_texts, vocabulary(WORD)).collect()}
    assert all(got[k][:-1] == lib[WORD].encode(t, add_special_tokens=False).ids for k, t in texts.items())
    pieces = packing.pack(long_texts, vocabulary(BYTE)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] - 1 for r in pieces} == {k: len(lib[BYTE].encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert {r["doc_id"]: r["n_words"] for r in quality.quality(long_texts).collect()} == {k: len(t.split()) for k, t in texts.items()}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(long_texts).collect()}
    assert near[4][1] == near[2][1] == 2 and near[1] == (1, 1) and near[4][0] > 199_000
    prints = {r["doc_id"]: r for r in fingerprints.with_edits(long_texts).collect()}
    assert prints[2]["fingerprint"] == prints[4]["fingerprint"] != prints[1]["fingerprint"]
    assert langid.predict(long_texts, langid.fit(long_texts)).filter("doc_id = 3 and lang_pred = 'und'").count() == 1
    assert toxicity.scores(long_texts, toxicity.Lexicon({"idiot": 1.0})).count() == 4
    assert secrets.scan(long_texts).count() == 4
    pages = long_texts.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.archive_and_read(pages).collect()} == {k: (len(t), 2 if k == 4 else None) for k, t in texts.items()}


def test_long_words_equal_the_library():
    from tokenizers import Tokenizer

    path, rng = vocabulary(WORD), random.Random(3)
    lib, codec = Tokenizer.from_file(path), bpe.codec(path, "word")
    for text in ("a" * 1000, "ab" * 700, "".join(rng.choice("etaoin") for _ in range(3000)), "é" * 800, "中文" * 500, "x" * 257, "x" * 256):
        assert list(codec.encode(text)) == lib.encode(text, add_special_tokens=False).ids
    with pytest.raises(KeyError):
        bpe.RankArray(path).ids("\n")  # no letter of the byte alphabet


def test_tokenizer_files_are_checked():
    for name, kind in ((WORD, "byte"), (BYTE, "word")):
        with pytest.raises(ValueError):
            tokens.encoder(vocabulary(name), kind)


def test_kept_words_are_bounded_by_bytes():
    ids = tokens.Ids(lambda w: w.encode(), 10_000)
    for i in range(5000):
        assert ids[f"w{i}"] == f"w{i}".encode()
    assert ids["x" * 1000] == b"x" * 1000 and "x" * 1000 not in ids
    assert len(ids) < 70 and len(ids.old) < 70


def test_id_files_are_read_by_another_session(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    idfiles.write_ids(docs, vocabulary(WORD), f"file://{tmp_path}/ids")
    (tmp_path / "ids").rename(tmp_path / "moved")
    out = idfiles.read_ids(spark.newSession(), f"file://{tmp_path}/moved")
    assert out.rdd.getNumPartitions() > 1
    lib, got = Tokenizer.from_file(vocabulary(WORD)), {r["doc_id"]: r for r in out.collect()}
    for r in docs.limit(50).collect():
        assert np.frombuffer(got[r["doc_id"]]["ids"], "<u4").tolist() == [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]


def test_archives_are_read_in_many_tasks(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    index = warc.write_archives(pages, f"file://{tmp_path}")
    assert warc.read_archives(index).rdd.getNumPartitions() > 1
    ids = re.compile(rb"WARC-Record-ID: (\S+)")
    rows = pages.limit(3).selectExpr("cast(null as long) as page_id", "url", "html")
    index = warc.write_archives(rows.union(rows), f"file://{tmp_path}/same")
    import zstandard

    seen = []
    for r in index.collect():
        data = (tmp_path / "same" / r["uri"].rsplit("/", 1)[1]).read_bytes()
        size = int.from_bytes(data[4:8], "little")
        made = {"dict_data": zstandard.ZstdCompressionDict(data[8 : 8 + size])} if size else {}
        seen.append(ids.search(zstandard.ZstdDecompressor(**made).decompress(data[r["offset"] : r["offset"] + r["bytes"]]))[1])
    assert len(set(seen)) == len(seen) == 6


@pytest.mark.parametrize("order", ["rising", "shuffled"])
def test_a_chain_of_links_takes_few_rounds(spark, order, monkeypatch):
    calls = []
    plain = near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, name: (calls.append(name), plain(df, name))[1])
    ids = [*range(2001)]
    if order == "shuffled":
        random.Random(1).shuffle(ids)
    out = near_dup.components(spark.createDataFrame([*zip(ids, ids[1:])], "a long, b long").repartition(4)).collect()
    assert len(out) == 2001 and {r["component"] for r in out} == {0}
    rounds = (calls.count("links") - 1) // 2
    assert rounds <= 15 and calls.count("parents") <= (15 if order == "rising" else 30)


def test_ids_with_unlike_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (3, a), (9, b), (7, c), (7, c + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df).collect())
    assert got == Counter({(5, 3): 3, (3, 3): 1, (9, 3): 1, (7, 7): 2})
    assert sorted(map(tuple, near_dup.one_of_each(df).collect())) == sorted([(3, a), (7, c), (7, c + " more")])
    alone = spark.createDataFrame([(5, a), (5, b)], "doc_id long, text string")
    assert near_dup.one_of_each(alone).count() == 2


def test_one_of_each_takes_the_same_row_wherever_rows_stand(spark):
    rows = [(1, "some words of a text", "en", s, {"k": s}) for s in "qbzafx"] + [(1, "some words of a text", None, "a", None), (2, None, "en", "b", None), (2, None, "en", "a", {})]
    schema = "doc_id long, text string, lang string, `x.y` string, m map<string, string>"
    got = [sorted(map(repr, near_dup.one_of_each(spark.createDataFrame(r, schema).repartition(n)).collect())) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert got[0] == got[1] and len(got[0]) == 2


def test_only_members_with_a_partner_get_their_sets():
    minmax, rng = near_dup.MinMax(near_dup.LONG_PERMS), np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, 100, dtype=np.uint64) for _ in range(6)]
    sets[4] = np.concatenate((sets[1][:97], sets[4][:3]))
    sigs = [(minmax(s) & np.uint32(255)).astype(np.uint8).tobytes() for s in sets]
    block = lambda comp, out: pa.table({"own": [0, 0, 0, 1, 1, 1], "i": [0] * 6, "j": [1] * 6, "rep": range(6), "n": [100] * 6, "component": comp, "outside": out, "sig": sigs, "set": [s.tobytes() for s in sets]})
    members = near_dup._block_members(block(range(6), [True] * 6), 0.85)
    assert members.column("rep").to_pylist() == [1, 4]
    assert near_dup._block_links(members, 0.85, 85).to_pylist() == [{"a": 1, "b": 4}]
    assert near_dup._block_members(block([0, 9, 2, 3, 9, 5], [True] * 6), 0.85).num_rows == 0
    assert near_dup._block_members(block(range(6), [False] * 6), 0.85).num_rows == 0


def test_languages_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))

    def counted(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        spaced = " " + "".join(w + " " for w in low.split(" ") if w)
        by = Counter(c for c in spaced if c != " ")
        for n in (2, 3):
            by.update(spaced[i : i + n] for i in range(len(spaced) - n + 1))
        return by

    best = lambda by: [number(g) for g in sorted(by, key=lambda g: (-by[g], number(g)))[:300]]
    plain = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None:
            plain[r["lang"]].update(counted(r["text"]))
    profiles = langid.fit(docs)
    assert profiles == {k: best(v) for k, v in plain.items()}
    ranks = {k: {g: i for i, g in enumerate(v)} for k, v in sorted(profiles.items())}
    want = {}
    for r in rows[:100]:
        own = best(counted(r["text"] or ""))
        away = {k: sum(abs(rank[g] - i) if g in rank else 300 for i, g in enumerate(own)) / (300 * len(own)) for k, rank in ranks.items()}
        lang = min(away, key=away.get)
        want[r["doc_id"]] = lang, 1 / sum(math.exp(-20 * (x - away[lang])) for x in away.values())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, profiles).collect()}
    assert len(want) == min(100, len(rows))
    for d, (lang, score) in want.items():
        assert got[d] == (lang, pytest.approx(score))


def test_ties():
    profiles = {"b": [97, 98], "a": [97, 98]}
    assert langid.Judge(profiles, 300, 20.0)("ab")[0] == "a"
    m = toxicity.Matcher(toxicity.Lexicon({"bad": 1.0}, {"bad": 1.0}))
    assert m.found("bad") == {0: (1.0, 3)}


def test_rare_languages_have_profiles(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(3000)] + [(5000 + i, "ein Hund und eine Katze", "de") for i in range(10)]
    assert set(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=50)) == {"de", "en"}


def test_fingerprints_of_long_texts_are_unbiased():
    rng, sampler, error = random.Random(1), fingerprints.Sampler(1024), []
    for k in range(4):
        a = [f"w{k}_{rng.randrange(20_000)}" for _ in range(20_000)]
        b = a[:10_000] + [f"w{k}_{rng.randrange(20_000)}" for _ in range(10_000)]
        x, y = Counter(a), Counter(b)
        error.append(fingerprints.likeness(sampler(" ".join(a)), sampler(" ".join(b))) - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(error)) < 0.025 and np.abs(error).max() < 0.06


def test_hot_keys_join_whole(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 1L when id % 3 = 1 then id else null end as k")
    table = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 2 = 1").withColumn("v", F.col("k") * 10)
    got = {r["id"]: r["v"] for r in common.spread_join(rows, table, "k", "n", 5000, ("id",), "left").collect()}
    assert len(got) == 5000 and all(got[r["id"]] == (r["k"] * 10 if r["k"] and r["k"] % 2 else None) for r in rows.collect())


def plain_fold(text):
    letters = {**toxicity.LOOK_ALIKES, **{k.upper(): v for k, v in toxicity.LOOK_ALIKES.items() if len(k.upper()) == 1}}
    out = []
    for i, c in enumerate(text):
        after, before = i + 1 < len(text) and text[i + 1].isalpha(), i > 0 and text[i - 1].isalpha()
        if c in toxicity.DIGITS and (before or after):
            out.append(toxicity.DIGITS[c])
        elif c in toxicity.SIGNS and after:
            out.append(toxicity.SIGNS[c])
        elif 0xFF21 <= ord(c) < 0xFF5B:
            out.append(chr(ord(c) - 0xFEE0).lower())
        else:
            out.append(letters.get(c, c.lower() if c.isalpha() and len(c.lower()) == 1 else c))
    return "".join(out)


def plain_found(lexicon, low):
    best, safe = {}, [(m.start(), m.end()) for p in lexicon.exceptions for m in re.finditer(f"(?={re.escape(p)})", low)]
    safe = [(a, a + len(p)) for p in lexicon.exceptions for a in [m.start() for m in re.finditer(f"(?={re.escape(p)})", low)] if not (a and low[a - 1].isalpha()) and not (a + len(p) < len(low) and low[a + len(p)].isalpha())]
    for m in re.finditer(r"[^\W\d_]+", low):
        word, start = m[0], m.start()
        hits = [(w, start + len(x)) for x, w in lexicon.stems.items() if word.startswith(x)] + [(w, start + len(x)) for x, w in lexicon.words.items() if word == x]
        if hits and not any(a <= start and max(hits)[1] <= b for a, b in safe):
            best[start] = max(w for w, _ in hits)
    return best


def plain_score(lexicon, text):
    total = sum(plain_found(lexicon, plain_fold(text or "")).values())
    a, b, c = lexicon.curve
    z = a + b * math.log1p(total) + c * min(10.0, 100.0 * total / max(20, len((text or "").split())))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.fit(docs, labels.filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if __import__("zlib").crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in text}
    n = defaultdict(lambda: [0, 0])
    for d, toxic in known.items():
        own = set(re.findall(r"[^\W\d_]+", plain_fold(text[d] or "")))
        for e in {w + "." for w in own} | {w[:k] for w in own for k in toxicity.STEMS if len(w) >= k}:
            n[e][toxic > 0] += 1
    base = sum(v > 0 for v in known.values()) / len(known)
    words, stems = {}, {}
    for e, (n0, n1) in n.items():
        m = n0 + n1
        if n1 >= 4 and n1 >= 0.7 * m and 2 * (n1 * math.log(n1 / (m * base)) + (n0 * math.log(n0 / (m * (1 - base))) if n0 else 0)) >= 24:
            (words if e.endswith(".") else stems)[e.rstrip(".")] = math.log((n1 + 0.5) / (n0 + 0.5)) - math.log(base / (1 - base))
    assert lexicon.words == pytest.approx(words) and lexicon.stems == pytest.approx(stems)
    phrases, bare = defaultdict(lambda: [0, 0]), toxicity.Lexicon(words, stems)
    for d, toxic in known.items():
        low = plain_fold(text[d] or "")
        w = re.findall(r"[^\W\d_]+", low)
        for p in {f"{a} {b}" for a, b in zip(w, w[1:])} if plain_found(bare, low) else ():
            if plain_found(bare, p):
                phrases[p][toxic > 0] += 1
    assert sorted(lexicon.exceptions) == sorted(p for p, (n0, n1) in phrases.items() if n0 >= 5 and not n1)
    some = [d for d in text if d % 7 == 0]
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs.filter("doc_id % 7 = 0"), lexicon).collect()}
    assert got == pytest.approx({d: plain_score(lexicon, text[d]) for d in some})


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    (_, first), (_, second), (_, third), (_, fourth), (_, fifth) = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept = common.written(first(spark, docs, sf), "kept")
    assert set(rows(kept)) == {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    profiles = langid.fit(kept.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    near = langid.Judge(profiles, 300, 20.0).nearest
    more = kept.select("doc_id", "text").union(spark.createDataFrame([(10_000, "Это русский текст без слов других языков"), (10_001, "1234 56")], "doc_id long, text string"))
    told = common.written(langid.identified(more, profiles, most_away=0.75), "told")
    assert set(rows(told)) == {d for d, t in rows(more).items() if near(t)[0] != "und" and near(t)[2] <= 0.75} == set(rows(kept)) == set(rows(second(spark, kept, sf)))
    one = common.written(third(spark, kept, sf), "one")
    assert set(rows(one)) == {d for d, (_, c) in groups([*rows(kept).items()], 5, 80).items() if c == d}
    clean = common.written(fourth(spark, one, sf), "clean")
    spans = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s] for r in secrets.scan(one).collect()}
    for d, t in rows(one).items():
        hidden = [False] * len(t)
        for a, b in spans[d]:
            hidden[a:b] = [True] * (b - a)
        parts = "".join("\x00" if h else c for c, h in zip(t, hidden))
        assert rows_text(clean, d) == re.sub("\x00+", "[SECRET]", parts) or len(spans[d]) > 1
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary(BYTE))
    pieces = packing.pack(clean, vocabulary(BYTE)).collect()
    assert {tuple(r)[:7] for r in pieces} == {tuple(r) for r in fifth(spark, clean, sf).collect()}
    whole = defaultdict(list)
    for r in sorted(pieces, key=lambda r: r["start"]):
        whole[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert dict(whole) == {d: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows(clean).items()}


def rows_text(df, doc_id):
    return df.filter(F.col("doc_id") == doc_id).first()["text"]
