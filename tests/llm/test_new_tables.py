"""Prefix trie, language identification and cohort retention on small tables, against plain versions."""

import collections
import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


# Running sums.


def test_running_sums_over_groups_that_are_cut(spark):
    from memaudit.llm.scan import running

    r = random.Random(3)
    rows = [(g, i, r.randrange(-50, 50), r.getrandbits(63)) for g, n in ((1, 300), (2, 1), (5, 40), (9, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long, w long").repartition(7)
    got = {(x.g, x.i): (x.s, x.x) for x in running(df, ["g", "i"], {"s": "v"}, "g", {"x": "w"}).collect()}
    want, total, mixed = {}, collections.Counter(), collections.Counter()
    for g, i, v, w in rows:
        total[g] += v
        mixed[g] ^= w
        want[g, i] = (total[g], mixed[g])
    assert got == want
    whole = {(x.g, x.i): x.s for x in running(df.drop("w"), ["g", "i"], {"s": "v"}).collect()}
    assert whole == dict(zip([(g, i) for g, i, _, _ in rows], np.cumsum([v for _, _, v, _ in rows]).tolist()))
    assert running(df.limit(0), ["g", "i"], {"s": "v"}).count() == 0


# Prefix trie.


def plain_trie(rows, base=lambda c: c, shared=lambda c: 0):
    """rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {c: tuple(own.get(base(c), [])[: shared(c)] + v[shared(c) :]) for c, v in own.items()}
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = {}
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == p)))
        saved = sum((len(members[q]) - 1) * (words(q[-1][1]) if q else 0) for q in below)
        out[min(convs), len(p)] = (min(members[p[:-1]]) if p else None, len(convs), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def of(rows):
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def spliced(c):
    return c - int(np.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_matches_plain_version(spark):
    from memaudit.llm.prefix_trie import conversation_trie

    r = random.Random(5)
    texts = ["a b", "", None, "c", " \t", "é x y", "a  b"]
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(texts[:3] if t < 3 else texts)) for c in range(-25, 60) if c != 20 for t in range(r.randrange(1, 7))]
    rows += [(None, 0, "user", "nobody")] * 3 + [(7, 3, "user", "tie b"), (7, 3, "user", "tie a"), (7, 3, "user", "tie a")]
    rows += [(100 + c, t, "user", "same") for c in range(30) for t in range(4)]  # one conversation of many ids
    rows += [(200 + c, t, "user", f"{min(t, 3 * c)}") for c in range(8) for t in range(25)]  # forks at every depth
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    extra = df.withColumns({"conv": F.lit("x"), "depth": F.lit(None), "k1": F.lit(1), "Text_": F.lit("y"), "pos": F.lit(2)})
    assert of(conversation_trie(extra).collect()) == plain_trie(rows)
    c = F.col("conv_id")
    got = conversation_trie(df, base=c - c % 20, shared=F.crc32(c.cast("string")) % 4).collect()
    assert of(got) == plain_trie(rows, lambda c: spliced(c)[0], lambda c: spliced(c)[1])
    spans = sorted((x.first, x.last, x.depth) for x in got)
    assert [s[0] for s in spans] == list(range(len(spans)))  # places are dense
    for x in got:  # an interval holds the node and what is below, no more
        inside = spans[x.first : x.last + 1]
        assert all(s[1] <= x.last and (s[0] == x.first or s[2] > x.depth) for s in inside)
        assert x.last + 1 == len(spans) or spans[x.last + 1][2] <= x.depth
        assert sum(s[0] == s[1] for s in inside) == x.n_leaves


def test_trie_of_an_endless_conversation_and_of_none(spark):
    from memaudit.llm import prefix_trie

    rows = [(1, t, "user", f"t{t % 7}") for t in range(3000)] + [(2, t, "user", f"t{t % 7}") for t in range(1500)] + [(3, 0, "user", "t0")]
    df = spark.createDataFrame(rows, TURNS)
    got = prefix_trie.conversation_trie(df).collect()
    assert len(got) == 3001 and {(x.conv_id, x.depth): (x.n_convs, x.n_leaves) for x in got}[1, 1] == (3, 1)
    assert max(got, key=lambda x: x.depth)["last"] == 3000 and all(x.last == 3000 for x in got)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "a")], TURNS)).count() == 0


def test_trie_digests_in_pieces(spark, monkeypatch):
    from memaudit.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rows = [(c, 0, "user", "same" if c % 3 else "other") for c in range(500)]
    assert of(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()) == plain_trie(rows)


# Language identification.


def test_ngram_buckets_do_not_depend_on_pieces(monkeypatch):
    from memaudit.llm import language_id

    r = random.Random(7)
    texts = ["", "a", "  ab, cd 12 éé!", "12 34", None, *("".join(r.choice("ab c.éÉ\n") for _ in range(r.randrange(1, 60))) for _ in range(60))]
    whole = [language_id.buckets(t) for t in texts]
    for piece in (1, 2, 3, 5, 17):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for t, (at, n) in zip(texts, whole):
            assert [x.tolist() for x in language_id.buckets(t)] == [at.tolist(), n.tolist()]
    at, n = language_id.buckets("Ab 1b")  # " ab b ": 6 letters and spaces, 5 pairs, 4 triples
    assert n.sum() == 15 and len(language_id.buckets("12 34")[0]) == 0


def test_naive_bayes_equals_plain_formula(spark):
    from memaudit.llm import language_id as li

    train = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("and the", "en")]
    model = li.fit(spark.createDataFrame(train, "text string, lang string"))
    assert model.languages == ["de", "en"]
    counts = {lang: np.full(li.BUCKETS, li.SMOOTHING) for lang in model.languages}
    for text, lang in train:
        at, n = li.buckets(text)
        counts[lang][at] += n
    for text in ("the katze", "und", "zzz the der"):
        at, n = li.buckets(text)
        logs = np.array([np.log(sum(x == lang for _, x in train) / 3) + (n * np.log(counts[lang][at] / counts[lang].sum())).sum() for lang in model.languages])
        names, scores = model.predict([text])
        assert names == [model.languages[logs.argmax()]]
        assert scores[0] == pytest.approx(1 / np.exp(logs - logs.max()).sum())


def test_language_of_held_out_documents(spark):
    from memaudit.llm.queries import op12_language_id

    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op12_language_id(spark, DATA).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r.lang_pred == docs[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.97 * len(held)


def test_language_edges(spark):
    from memaudit.llm.language_id import identify_languages

    schema = "doc_id long, text string, lang string, held_out string, score int, Lang_pred int"
    rows = [(1, "the and of " * 9, "en", "x", 1, 1), (2, "und der die " * 9, "de", "x", 1, 1), (2, "und der die " * 9, "de", "x", 1, 1), (None, "the of", None, None, None, None), (4, None, "en", None, None, None), (6, "", "de", None, None, None), (7, "12 !?", "en", None, None, None), (8, "the of and " * 200_000, None, None, None, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.lang_pred, r.score) for r in identify_languages(spark.createDataFrame(rows, schema)).collect())
    assert [g[:2] for g in got] == [(-1, "en"), (1, "en"), (2, "de"), (2, "de"), (4, "und"), (6, "und"), (7, "und"), (8, "en")]
    assert all(0 <= g[2] <= 1 for g in got) and [g[2] for g in got if g[1] == "und"] == [0, 0, 0]
    assert identify_languages(spark.createDataFrame([], schema)).count() == 0
    nothing = identify_languages(spark.createDataFrame([(1, "a b", None, None, None, None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


# Cohort retention.

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def plain_retention(clicks, clients, known_by, cohort_days=1, period_days=1):
    segment = {}
    for c, s in clients:
        if c is not None and s is not None:
            segment[c] = min(segment.get(c, s), s)
    events = [e for e in set(clicks) if e[1] is not None and e[3] is not None]
    cells, cohorts = collections.defaultdict(lambda: [set(), 0]), {}
    for state in (0, 1):
        known = [e for e in events if state or e[2] is not None and e[2] < known_by]
        starts = {}
        for e in known:
            if e[4] == "signup":
                starts[e[3]] = min(starts.get(e[3], e[1]), e[1])
        for e in known:
            if e[3] in starts and e[1] >= starts[e[3]]:
                start = starts[e[3]]
                cohorts[state, e[3]] = (start - dt.datetime(1970, 1, 1)) // DAY // cohort_days
                cell = cells[state, segment.get(e[3], ""), cohorts[state, e[3]], (e[1] - start) // (period_days * DAY)]
                cell[0].add(e[3])
                cell[1] += int(np.floor(100 * e[5] + 0.5)) if e[5] is not None and np.isfinite(e[5]) else 0
    moved = {c for s, c in cohorts if (0, c) in cohorts and (1, c) in cohorts and cohorts[0, c] != cohorts[1, c]}
    return {k: (len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(u & moved), cents) for k, (u, cents) in cells.items()}


def shop(seed, n, clients):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ts = START + DAY * r.choice([r.random() * 60, r.randrange(60), r.randrange(60) - 1e-6 / 86400])
        who = r.choice([7, 7, None, *range(clients)])
        out.append((r.choice([i, i, None]), r.choice([ts] * 20 + [None]), r.choice([ts + DAY * r.random() * 40] * 9 + [None]), who, r.choice(["signup", "view", "view", None]), r.choice([None, float("inf"), -1.005, 2.675, r.uniform(-9, 9)]), r.choice(["{}", None])))
    return out + out[:: max(n // 9, 1)]


def found(df):
    return {(r.state, r.segment, r.cohort, r.period): (r.users, r.users_crc32, r.moved, r.cents) for r in df.collect()}


def test_retention_matches_plain_version(spark):
    from memaudit.llm.retention import retention

    rows = shop(11, 1500, 40)
    clients = [(c, random.Random(c).choice(["a", "b", None])) for c in range(0, 36)] + [(3, "z"), (3, "0"), (None, "q")]
    frame = spark.createDataFrame(rows, CLICKS).repartition(5)
    people = spark.createDataFrame([(*c, "x", 1) for c in clients], "client_id long, segment string, client string, number int")
    known = dt.datetime(2024, 2, 1)
    assert found(retention(frame, people, known_by=str(known))) == plain_retention(rows, clients, known)
    assert found(retention(frame, people, known_by=str(known), cohort_days=7, period_days=5)) == plain_retention(rows, clients, known, 7, 5)


def test_retention_of_chunks_and_small_buffers(spark, monkeypatch):
    from memaudit.llm import retention as module

    monkeypatch.setattr(module, "COMBINE", 50)
    ids = range(-3000, 7000)  # ten chunks; one client has a third of the rows
    rows = [(c, START + DAY * (c % 3), START, c, "signup", 1.0, None) for c in ids] + [(10**6 + i, START + DAY * (5 + i % 9), START, 5, "view", 0.25, None) for i in range(5000)]
    clients = [(c, "s") for c in ids]
    got = found(module.retention(spark.createDataFrame(rows, CLICKS).repartition(4), spark.createDataFrame(clients, "client_id long, segment string")))
    assert got == plain_retention(rows, clients, dt.datetime(2024, 2, 15))


def test_hot_cells_have_few_containers(spark, monkeypatch):
    """A client with most of the events, dealt over many tasks and buffers, brings at most PIECES containers a cell to a chunk's part."""
    from memaudit.llm import retention as module

    monkeypatch.setattr(module, "COMBINE", 20)
    rows = [(c, START, START, c, "signup", 1.0, None) for c in range(50)] + [(10**6 + i, START + DAY * (1 + i % 3), START, 5, "view", 0.25, None) for i in range(4000)]
    most, merged = [], module._merged

    def counted(both):
        most.append(both.where("kind = 1").groupBy("chunk", "state", "segment", "cohort", "period").count().agg(F.max("count")).first()[0])
        return merged(both)

    monkeypatch.setattr(module, "_merged", counted)
    clients = [(c, "s") for c in range(50)]
    got = found(module.retention(spark.createDataFrame(rows, CLICKS).repartition(8), spark.createDataFrame(clients, "client_id long, segment string")))
    assert got == plain_retention(rows, clients, dt.datetime(2024, 2, 15))
    assert most[0] <= module.PIECES


def test_retention_edges(spark):
    from memaudit.llm.retention import retention

    none, people = spark.createDataFrame([], CLICKS), spark.createDataFrame([], "client_id long, segment string")
    assert retention(none, people).count() == 0
    one = spark.createDataFrame([(1, START, None, 4, "signup", None, None)] * 3 + [(1, START, START, None, "signup", 1.0, None), (1, None, START, 4, "view", 1.0, None)], CLICKS)
    got = retention(one.withColumns({"client": F.lit(1), "at": F.lit("x"), "start0": F.lit(0), "bit": F.lit(None).cast("string")}), people)
    assert found(got) == {(1, "", 19723, 0): (1, zlib.crc32(b"4"), 0, 0)}
    zoned = one.withColumn("ts", F.col("ts").cast("timestamp"))
    assert found(retention(zoned, people)) == found(got)


def test_containers_round_trip():
    from memaudit.llm.retention import pack, unpack

    r = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1023, 1024):
        bits = np.sort(r.choice(1024, n, replace=False))
        assert unpack(pack(bits)).tolist() == bits.tolist()
        assert len(pack(bits)) <= 129


# Line dedup by id.


def test_lines_count_documents_by_id(spark, monkeypatch):
    from memaudit.llm import line_dedup

    docs = "doc_id long, text string"

    def lines(texts, **options):
        df = spark.createDataFrame(texts, docs).repartition(5)
        return collections.Counter((x.doc_id, x.kept) for x in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, 10, **options)).collect())

    def plain(texts):
        seen = collections.defaultdict(set)
        for d, t in texts:
            for line in t.split("\n"):
                seen[line].add(d)
        return collections.Counter((d, "\n".join(x for x in t.split("\n") if len(seen[x]) < 10)) for d, t in texts)

    one = [(5, f"same\nown {i}") for i in range(10)]
    assert lines(one) == plain(one) and sum("same" in k for _, k in lines(one)) == 10  # ten texts of one document
    nine = one + [(100 + i, f"same\nother {i}") for i in range(8)]
    assert lines(nine) == plain(nine)
    ten = nine + [(None, "same\nnull"), (None, "same")]
    assert lines(ten) == plain(ten) and not any(k.startswith("same\n") for _, k in lines(ten))
    monkeypatch.setattr(line_dedup, "HELD_ROWS", 7)
    many = [(i % 9 or None, f"same\n{i}") for i in range(400)] + [(d, f"common\n{d} {j}\nrare") for d in range(20) for j in range(15)]
    for texts in (many, many + [(77, "rare\nsame")]):
        assert lines(texts) == plain(texts)
    kept = lines(many + [(77, "same")], keep="first")
    assert sum(k.split("\n").count("same") for (_, k), n in kept.items() for _ in range(n)) == 1


# Edges of earlier operators.


def test_encoding_and_packing_of_odd_rows(spark):
    import struct

    from memaudit.llm.byte_bpe import encode_decode
    from memaudit.llm.packing import pack
    from memaudit.llm.queries import tokenizer

    kind = "doc_id long, text string, ids string, decoded int, ID int, pack_id string"
    rows = [(1, "a b c", "x", 1, 1, "p"), (1, "a b c", "x", 1, 1, "p"), (None, "null id", None, None, None, None), (None, None, None, None, None, None), (5, "", None, None, None, None)]
    tok = tokenizer(spark)
    got = encode_decode(spark.createDataFrame(rows, kind), tok).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(x[1] or "" for x in rows)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(x[0] for x in rows)
    packed = pack(encode_decode(spark.createDataFrame(rows, kind), tok, decode=False).withColumns({"pack_id": F.lit("x"), "starts": F.lit(1)}), window=8).collect()
    held = collections.Counter()
    for p in packed:
        ids = struct.unpack("<8H", bytes(p.ids))
        for doc, a, b in zip(p.doc_ids, p.cu_seqlens, p.cu_seqlens[1:]):
            held[doc, ids[a:b]] += 1
    want = collections.Counter((r.doc_id, (*np.frombuffer(bytes(r.ids), "<u4").tolist(), 50256)) for r in got)
    assert held == want
    assert encode_decode(spark.createDataFrame([], kind), tok).count() == 0
    assert pack(encode_decode(spark.createDataFrame([], kind), tok, decode=False)).count() == 0


def test_quality_with_clashing_columns(spark):
    from memaudit.llm.quality import classify

    docs = spark.createDataFrame([(i, f"some words {i} here." if i % 2 else "BUY!!! $$$ 99", "x", 2, 3.0, 1) for i in range(40)] + [(None, None, None, None, None, None)], "doc_id long, text string, held_out string, score int, x double, quality int")
    labels = spark.createDataFrame([(i, i % 2, "t", 1) for i in range(40)], "doc_id long, quality int, text string, x int")
    got = classify(docs, labels).collect()
    assert len(got) == 41 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None)
