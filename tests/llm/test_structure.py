"""Conversation repair, cross-tokenizer alignment and line dedup against brute force, on given tables and on awkward rows."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import alignment, conversations, line_dedup, packing, queries, secrets, toxicity
from pulsegrid.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        if hit:
            out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def brute_repair(rows):
    """Rows (turn, role, text) of one conversation -> gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    turns = {r[0] for r in rows if r[0] is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        text_end = text.strip(SPACE)[-1:]
        faults.append("blank" if not text_end else "duplicate" if (role, text) in seen else "truncated" if text_end not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, done) in list(best.items()):
                for r, role in (("u", "user"), ("a", "assistant")):
                    if to := nexts.get((state, r)):
                        new = (cost + 2, audit + "I", (*done, (role, "")))
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def put(to, value):
            if to and (to not in new or value[:2] < new[to][:2]):
                new[to] = value

        for state, (cost, audit, done) in insert(dict(best)).items():
            value = (cost + 3, audit + "D", done)
            if state not in new or value[:2] < new[state][:2]:
                new[state] = value
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            put(nexts.get((state, role[:1])), (cost + late, audit + "K", (*done, (role, text))))
            for r, name in (("u", "user"), ("a", "assistant")):
                put(nexts.get((state, r)), (cost + 2 + late, audit + "R", (*done, (name, text))))
        best = new
    cost, audit, done = min((v for k, v in insert(dict(best)).items() if k in ("", "a")), key=lambda v: v[:2])
    n = Counter(faults)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha)


def brute_report(everything, rows):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(row)
    return {conv: brute_repair(by[conv]) for conv in {r[0] for r in everything}}


SCHEMA = "conv_id long, turn long, role string, text string, component string, `x.y` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)


def report(out):
    rows = out.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def odd_conversations(n, seed):
    rng = random.Random(seed)
    words = ["Yes.", "no", "", "  \t", "What?", "été!", "a. b", "x. ", "."]
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice([None, *words])))
    return rows + rows[: n // 4]


def test_conversations_of_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(queries.op11_conversation_repair(spark, sf)) == brute_report(rows, brute_damage(rows))


def test_odd_conversations(spark):
    rows = odd_conversations(300, 5)
    df = frame(spark, rows)
    assert Counter(map(tuple, queries.damaged(df).collect())) == Counter(brute_damage(rows))
    assert report(conversations.report(queries.damaged(df), df)) == brute_report(rows, brute_damage(rows))
    assert conversations.report(df.limit(0), df.limit(0)).count() == 0
    gone = conversations.report(df.limit(0), df.filter("conv_id = 3")).first()
    assert tuple(gone) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.mark.parametrize("size", [2])
def test_conversations_in_chunks(spark, size):
    """Long conversations, among them rows whose costs never converge, give what whole ones give."""
    rng = random.Random(size)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", ""]) + str(i % 9) + rng.choice([".", ""])) for i in range(60)]
    rows += [(2, i, "tool", f"row {i}.") for i in range(25)] + [(3, i, "user", "the same.") for i in range(20)] + [(4, i, ("user", "assistant")[i % 2], f"row {i}") for i in range(20)]
    rows += [(5, 0, "user", "copies.")] * 40 + [(5, i, "system", f"{i}!") for i in range(3)] + [(6, 0, "system", "alone.")]
    df = frame(spark, rows)
    assert report(conversations.report(df, df, size)) == brute_report(rows, rows)
    _, chunks, fine = conversations.repair(df, size)
    assert chunks.count() >= 60 / size
    roles = "".join(r["role"][0] for r in fine.filter("c = 1 and not cn").orderBy("no", "at", "k").collect())
    assert re.fullmatch("(s?(ua)+)?", roles) and set("IK") <= {r["edit"] for r in fine.collect()}


def test_cost_vectors():
    """Every vector is a minimum of the speculative ones, and chunks' tables multiply as the search does."""
    rng = random.Random(1)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(12)))
        b = conversations.TERMINAL
        for code in reversed(codes):
            b = conversations.before(b, code)
            assert all(b[k] == min(b[j] + conversations.REACH[k][j] for j in range(4)) for k in range(4))
        m = conversations.transfer(codes)
        through = [min(m[4 * k + j] + conversations.TERMINAL[j] for j in range(4)) for k in range(4)]
        assert [x - min(through) for x in through] == [x - min(b) for x in b]


def brute_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from pulsegrid.llm.tokens import byte_alphabet

    a, b = Tokenizer.from_file(vocabulary(A)), SentencePieceProcessor(model_file=vocabulary(B))
    a.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_alphabet())}
    per, count = [], Counter()
    for doc_id, text in docs:
        groups, links = [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
            yb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
            if b"".join(xb) == b"".join(yb) == (" " + text).encode():
                ea, eb = (list(itertools.accumulate(map(len, v))) for v in (xb, yb))
                cuts = sorted({*ea} & {*eb})
                low = 0
                for cut in cuts:
                    ga, gb = ([i for i, e in zip(ids, e_) if low < e <= cut] for ids, e_ in ((x, ea), (y, eb)))
                    groups.append((ga, gb))
                    links += itertools.product(ga, gb)
                    low = cut
        count.update(set(links))
        per.append((doc_id, groups, links))
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for doc_id, groups, links in per:
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        sums = (sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links))
        out.append((doc_id, *sums, hashlib.sha256(shown.encode()).hexdigest() if groups else "", sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links)))
    return Counter(out)


ODD_TEXTS = [
    None, "", " ", "  ", "\n", "a", "word " * 50, "café Été\tnaïve 日本語のテキスト \U0001f600\U0001f468‍\U0001f469", "<s> </s> <unk> <0x0A> <|endoftext|> <|endoftext|>x",
    "tabs\t\tand\r\n returns\r \rx \n\n  y  ", "▁under▁ score", "nb sp 　 wide x\u0085y\x1cz \x1d w", "can't we'll  I'M ''s", "    def f(x):\n\treturn {\r\n}\r\n);\r", "x" * 300 + " " * 70 + "=" * 90, "ﬁne İ ẞ", "12345 67 8.9e10,000", "\x00\x01 �",
]


def aligned(out):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    return Counter(tuple(r[n] for n in names) for r in out.select(*names).collect())


@pytest.mark.parametrize("most_pairs", [1 << 19, 0, 40])
def test_alignment(spark, sf, most_pairs):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (1001, "a")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, part string")
    assert aligned(alignment.align(df, vocabulary(A), vocabulary(B), most_pairs, digest=True)) == brute_alignment(docs)


def test_alignment_of_no_rows_and_as_a_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert alignment.align(docs.limit(0), vocabulary(A), vocabulary(B)).count() == 0
    out = queries.op12_alignment(spark, sf)
    assert out.count() == docs.count() and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_alignment_of_random_texts():
    from tokenizers import Tokenizer

    align, rng = alignment.Aligner(vocabulary(A), vocabulary(B), room=50_000), random.Random(4)
    lib = Tokenizer.from_file(vocabulary(A))
    lib.encode_special_tokens = True
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", "ing", " ", "  ", "\n", "\t", "\r", " ", "　", "'s", "1", "é", "中", "}", ";", "\U0001f600", " "]) for _ in range(rng.randrange(1, 30)))
        parts = alignment.WORDS.findall(" " + text)
        assert "".join(parts) == " " + text
        ids = [*map(align.encode, [[p] for p in parts])]
        assert [i for ((a, _),) in ids for i in a] == lib.encode(" " + text, add_special_tokens=False).ids
        assert [i for ((_, b),) in ids for i in b] == align.b.encode(text)


def test_galloping():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(1, 200), rng.randrange(0, 60))) for _ in range(2))
        assert alignment.common_ends(a, b) == [(a.index(x), b.index(x)) for x in a if x in set(b)]


def test_large_groups():
    """Pairs of a large group are counted, not listed."""
    align = alignment.Aligner(vocabulary(A), vocabulary(B))
    for table, sizes, new in ((align.a_bytes, align.a_sizes, {5: b"ab", 6: b"a", 11: b"aa"}), (align.b_bytes, align.b_sizes, {9: b"aab", 10: b"ab", 11: b"a", 12: b"aa", 13: b"a"})):
        for i, data in new.items():
            table[i], sizes[i] = data, len(data)
    word = align.aligned("a" + "ab" * 99, [6, *[5] * 99], [9, *[10] * 98])
    assert word.heavy is None and word.sizes == (100, 99, 99)
    n = 200
    word = align.aligned("a" * (2 * n), [11] * n, [11, *[12] * (n - 1), 13])
    assert word.heavy and word.sizes[2] == 1
    _, _, _, _, pairs, times = alignment.text_groups([word, word])
    assert dict(zip(pairs.tolist(), times.tolist())) == {11 << 15 | 11: 2 * n, 11 << 15 | 12: 2 * n * (n - 1), 11 << 15 | 13: 2 * n}


def brute_lines(docs):
    low = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())
    rank = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    split = [(d, (t or "").split("\n")) for d, t in docs]
    key = lambda line: line.strip(SPACE).translate(low)
    for d, lines in split:
        for line in lines:
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = Counter()
    for d, lines in split:
        kept = [x for x in lines if key(x) not in holders or d == min(holders[key(x)], key=rank)]
        out[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


LINES = [
    (5, "A line of its own\n  the SHARED line here \t\nshort\nthe shared line here"), (3, "the shared line here\n\nthe shared line here\r"), (3, "the shared line here"), (9, None), (9, "short\nshort"), (None, "the Shared line here\nonly without id\n"),
    (None, "only without id\n"), (7, ""), (8, "\n\n"), (10, "Été a long line\nété a long line"), (11, "été a long line\nÉTé A LONG LINE"), (-2, " the shared line here"), (12, "nine char\nnine char"), (13, "nine char\n0123456789\n" + "0123456789\n" * 5000), (12, "0123456789"),
]


def lines_frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, th string, pos int")


def test_line_dedup(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for rows in (LINES, docs, LINES * 3):
        assert Counter(map(tuple, line_dedup.digests(lines_frame(spark, rows)).collect())) == brute_lines(rows)
    assert line_dedup.digests(lines_frame(spark, LINES).limit(0)).count() == 0


def test_line_in_all_documents(spark):
    """A key that fills several ranges keeps its one first occurrence."""
    rows = [(i, f"the line of all documents\nline number {i // 2} of a pair\n") for i in range(4000)]
    df = lines_frame(spark, rows).repartition(16)
    assert Counter(map(tuple, line_dedup.digests(df).collect())) == brute_lines(rows)
    maps = line_dedup.keep_bitmaps(df)
    assert maps.count() == 3999 and maps.selectExpr("max(length(keep))").first()[0] < 20
    one = maps.filter("doc = 7").first()
    assert line_dedup.kept_lines(rows[7][1], bytes(one["keep"])) == [""]


def test_line_dedup_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = Counter(con.execute(queries.oracle_sql()["op13_line_dedup"]).fetchall())
    got = queries.op13_line_dedup(spark, "/root/testdata/sf0.01")
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want
    assert np.sum([n for (_, _, n, _), m in want.items() for _ in range(m)]) > 0


def test_packing_fills_every_window_to_target(spark):
    """All 20 sources of the given table are served their target, within two tokens, in every window until a source runs dry."""
    sf = "/root/testdata/sf0.01"
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    by, total = defaultdict(Counter), Counter()
    for r in queries.op3_packing(spark, sf).collect():
        by[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
        total[source[r["doc_id"]]] += r["length"]
    share = {q: 2048 * n / total.total() for q, n in total.items()}
    near, left = 0, Counter(total)
    for s in sorted(by):
        if min(left.values()) < 200:
            break
        assert by[s].total() == 2048 and all(abs(by[s][q] - share[q]) <= 2 for q in share)
        near += 1
        left.subtract(by[s])
    assert len(total) == 20 and near > 0.95 * total.total() / 2048


@pytest.mark.parametrize("n", [1, 3, 700, 2048])
def test_layout_of_thin_lanes(n):
    """Lanes of about a token a window still find their windows."""
    totals = [3000 + i % 3 for i in range(n)]
    layout, by = packing.Layout(totals, [float(t) for t in totals], 2048), Counter()
    for q in range(0, n, max(1, n // 50)):
        _, start, length, seq, offset = layout.pieces(q, np.array([0, 100]), np.array([100, totals[q] - 100]))
        assert length.sum() == totals[q] and (length > 0).all() and (offset + length <= 2048).all()
        for m, s in zip(length.tolist(), seq.tolist()):
            by[q, s] += m
    assert all(m <= 2048 * totals[q] / sum(totals) + 2 for (q, s), m in by.items() if s < layout.phases[0].windows)


def spans_of(text):
    return secrets.novel_spans(text, secrets.base_spans(text), secrets.Novelty(), 48, 256, 0.5)


@pytest.mark.parametrize("text", ["see api docs https://example.com/path/to/resource123/item4567 for more", "my key points: 2024annualreportsummary1 and more", "token_type/access_token_expiry_2024/refresh_token_v2"])
def test_paths_and_names_are_no_secrets(text):
    assert spans_of(text) == []


def test_planted_secrets_by_precision_and_recall():
    """Random keys behind words of context, without an assignment, among words, paths and repeated names: all are found, and little else."""
    rng, letters = random.Random(6), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "the report of a value is given by function handleRequest in module parser_utils with config_value and session_handler for version2 path/to/file12 internationalisation".split()
    found = wrong = 0
    for i in range(300):
        key = "".join(rng.choice(letters) for _ in range(rng.randrange(20, 44)))
        body = [rng.choice(words) for _ in range(80)]
        at = rng.randrange(80)
        planted = i % 3 > 0
        body[at:at] = [rng.choice(["credential", "private key", "bearer", "auth key is", "pwd"]), key if planted else rng.choice(words)]
        text = " ".join(body)
        spans = spans_of(text)
        hits = [text[a:b] == key for a, _, b in spans]
        found += any(hits)
        wrong += len(hits) - sum(hits)
    assert found >= 0.97 * 200 and wrong <= 4


def test_secret_time_follows_length():
    took = []
    for n in (1000, 8000):
        text = "".join(f"key{i}x" for i in range(n)) + " the end"
        start = time.process_time()
        spans_of(text)
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0] + 0.5


def test_a_run_of_keys_is_reported_to_its_end():
    key = "Q7vX2mN8pL4kR9tZw3apiJ5hT1yU6"
    text = f"the credential {key} ends"
    assert [text[a:b] for a, _, b in spans_of(text)] == [key]


def test_secret_bytes_of_base_spans(spark):
    rows = [(1, "token=abcdef0123456789 and token=" + "token" * 5), (2, None), (3, "nothing here")]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    costs = [*map(int, got[1]["base_bytes"].split(","))]
    assert len(costs) == 2 and costs[0] > costs[1] and got[2]["base_bytes"] == got[3]["base_bytes"] == ""


def test_toxic_exceptions_in_time():
    m = toxicity.Matcher(toxicity.Lexicon({"bad": 2.0}, {}, ["not bad", "so not bad at all"], (0.0, 1.0, 1.0)))
    start = time.process_time()
    assert not m.found("so not bad at all, not bad " * 40_000) and time.process_time() - start < 5
    assert len(m.found("so not bad at all. bad, not bad; bad not")) == 2
    assert m.features("bad " + "word " * 199) == m.features("bad\n" + "word\n" * 199)
