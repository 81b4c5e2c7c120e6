"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanlake.llm import bpe, decontaminate, licences, neardup, ordinal, pii, queries, repeats, rules, secrets, shards, trigrams

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string"
OPERATORS = {
    "bpe": lambda d: bpe.round_trip(d, VOCAB),
    "neardup": neardup.near_duplicates,
    "pii": pii.find,
    "licences": licences.scan,
    "repeats": repeats.remove_repeats,
    "shards": shards.shuffle,
    "secrets": secrets.scan,
    "rules": rules.judge,
    "decontaminate": lambda d: decontaminate.scan(d, d.selectExpr("doc_id as item_id", "text")),
    "ordinal": lambda d: ordinal.select(d, d.selectExpr("doc_id", "cast(pmod(doc_id, 3) as int) as grade")),
}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(spark, name):
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "word " * 3000, None, "s"), (3, "é" * 5000, "fr", None), (None, "a b c", "en", "s"), (4, " \n\t ", "en", "s")]
    docs = table(spark, rows, SCHEMA).selectExpr("*", "1 as n_words", "'x' as spans", "2 as shingles", "3 as kept", "4 as size", "5 as licences", "6 as secret_spans")
    assert OPERATORS[name](docs).count() == len(rows)
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_bpe_equals_library(spark):
    lib = Tokenizer.from_file(VOCAB)
    own, rnd = bpe.load(VOCAB), random.Random(1)
    pieces = ["a", "the", " ", "\n", "<|endoftext|>", "é", "☃", "0", "ing", "'s", ".", " ", "\x1c", "\x85", "जी"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(300))) for _ in range(200)] + ["abcdefinth" * 400]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    row = bpe.round_trip(table(spark, [(1, texts[0])]), VOCAB).first()
    assert row.ids_sha256 == sha(",".join(map(str, lib.encode(texts[0], add_special_tokens=False).ids))) and row.lossless
    back = bpe.decode(bpe.encode(table(spark, [(1, texts[1])]), VOCAB), VOCAB).first()
    assert back.text == texts[1]


def near_brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("hot", [64, 8])
def test_near_duplicates(spark, hot):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    bases = [[rnd.choice(words) for _ in range(150)] for _ in range(3)]
    rows = []
    for i in range(360):
        own = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 3, 4, 6, 9])):
            own[rnd.randrange(150)] = rnd.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  B"), (904, "É b"), (905, "é b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows), hot=hot).collect()}
    assert got == near_brute(rows)


def test_pii_base(spark):
    rnd = random.Random(0)

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
            if 14 <= len(d) <= 19 and sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d)) % 10 == 0:
                out.append((m.start(), 2, m.end()))
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])

    parts = ["a", "@", ".", "a.b", "@x.y", "1", "12", "255", "4111111111111111", "1.2.3.4", "300", "+1", "-", " ", "(", "%", "é", "+", "0.0.0.00"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))
        assert [(s, pii.KINDS.index(k), e) for k, s, e, _ in pii.spans(t) if k in pii.BASE] == brute(t), t
    assert [k for k, *_ in pii.spans("iban GB82 WEST 1234 5698 7654 32 now")][:1] == ["iban"]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_decontaminate_blocks_agree(spark):
    rnd = random.Random(2)
    words = [f"q{k}" for k in range(40)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 18)))) for i in range(30)] + [(30, None), (None, "zz yy")]
    rows = [(i, " ".join([rnd.choice(words).upper() + rnd.choice(["", ",", "!"]) for _ in range(20)] + [rnd.choice(items)[1] or "" for _ in range(2)])) for i in range(80)] + [(200, "zz, YY"), (201, None)]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {(i, tuple(w[k : k + 10])) for i, t in items if (w := norm(t)) for k in range(max(1, len(w) - 9))}
    want = {}
    for i, t in rows:
        w, hit, ids = norm(t), set(), set()
        for item, p in wins:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= {str(item)} - {"None"}
        want[i] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (4_000_000, 300):
        got = decontaminate.scan(table(spark, rows), bench, max_chars=most).collect()
        assert {r.row.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
        assert all(dict(rows)[r.row.doc_id][s.start : s.end] for r in got for s in r.spans)


@pytest.mark.parametrize("small", [48, 2])
def test_repeats(spark, small):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(rnd.randrange(30, 160))) for _ in range(8)]
    rows = []
    for i in range(150):
        t = ""
        for _ in range(rnd.randrange(5)):
            x = rnd.choice(pool)
            a = rnd.randrange(len(x))
            t += rnd.choice([" ".join(word() for _ in range(60)), x[a : a + rnd.randrange(150, 700)], rnd.choice(["a", "ab", "\n"]) * rnd.randrange(1, 150)])
        rows.append((i, t))
    rows += [(1, rows[1][1]), (None, rows[2][1]), (None, None), (900, "x" * 199), (901, "z" * 201), (902, "q" * 5000)]
    count = collections.Counter(b[p : p + 200] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        want.append((str(i), len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(spark, rows), small).collect()]
    assert sorted(got) == sorted(want)


def test_shards(spark):
    rows = [(i, None if i % 50 == 0 else f"text {i % 300} é") for i in range(1003)]
    got = shards.shuffle(table(spark, rows)).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(sizes) == 40 and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["nunique"] == sizes["count"]).all() and (sizes["max"] == sizes["count"] - 1).all()
    for r in got.itertuples():
        b = (dict(rows)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 16, zlib.crc32(b))
    matrix = shards.communication([5, 0, 70, 8], [21, 21, 21, 20], 3)
    assert [sum(r) for r in matrix] == [5, 0, 70, 8] and [sum(c) for c in zip(*matrix, strict=True)] == [21, 21, 21, 20]


def secret_brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark):
    rnd = random.Random(3)
    parts = ["token", "PassWord", "api_key", "ApiKey", " ", "=", ":", '"', "'", "abc", "AKIA", "Z9Z9Z9", "0123456789abcdef", "é", "\n", "😀", "secret", "passwd", "x", ".", "-", "deadbeef" * 4]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))) for i in range(1500)]
    got = {r.row.doc_id: [(s.start, s.rank, s.end) for s in r.secret_spans if s.rank < 3] for r in secrets.scan(table(spark, rows)).collect()}
    assert got == {i: secret_brute(t) for i, t in rows}
    for rule in secrets.BASE + secrets.MORE:
        for _, t in rows[:200]:
            held = {t.lower()[k : k + 3] for k in range(len(t))}
            query = trigrams.derive(rule.pattern)
            assert not re.search(rule.pattern, t, re.ASCII) or (trigrams.satisfied(query, held) and trigrams.satisfied(trigrams.thinned(query), held))
    assert trigrams.derive("[0-9a-f]+") is True


def test_rules(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(["a", "b ", " ", "c ", "\n", "\t", "#", "é ", "|", "x y z ", "\x0b"]) for _ in range(rnd.randrange(60)))) for i in range(800)]

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = collections.Counter(tri)
        at = {i + k for i, x in enumerate(tri) if seen[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at)

    got = {r.row.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.stats(table(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}
    words = [f"{a}{b}" for a in "qwertzuiop" for b in "asdfghjkl"]
    clean = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "s", "ing"]) for _ in range(90)), "en", "s") for i in range(120)]
    junk = [(1000 + i, " ".join(rnd.choice(words) + rnd.choice("%#") * 3 for _ in range(90)), "en", "s") for i in range(10)]
    kept = {r.row.doc_id: r.kept for r in rules.judge(table(spark, clean + junk, SCHEMA)).collect()}
    assert all(kept[i] == (i < 1000) for i in kept)


def test_licences_and_ordinal(spark):
    texts = [(1, "Intro\nReleased under the MIT License.\nend"), (2, "a driver must carry a licence at all times"), (3, "Licensed under CC BY-NC 4.0."), (4, "plain")]
    got = {r.row.doc_id: [s.family for s in r.licences if s.family != "unknown"] for r in licences.scan(table(spark, texts)).collect()}
    assert got == {1: ["mit"], 2: [], 3: ["cc-by-nc"], 4: []}
    rnd = random.Random(4)
    bad = {0: ["scum", "moron"], 1: ["%%%", "###"], 2: []}
    rows = [(i, " ".join(rnd.sample([f"n{k}" for k in range(400)], 40) + bad[i % 3] * 3)) for i in range(600)]
    rated = spark.createDataFrame([(i, i % 3) for i in range(400)], "doc_id long, grade int")
    held = {r.doc_id: r.kept for r in ordinal.select(table(spark, rows), rated).collect()}
    assert sum(held[i] == (i % 3 == 2) for i in range(400, 600)) >= 180  # held-out accuracy of 0.9 from 400 rated rows


def test_pipeline_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, d)
    assert kept.columns == docs.columns
    one = corpus_pipeline.near_dedup(spark, kept, d)
    roots = near_brute([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in roots.items() if i == c)
    clean = corpus_pipeline.decontaminated(spark, one, d)
    bare = {r.doc_id: r.text for r in clean.collect()}
    again = decontaminate.scan(clean, spark.read.parquet(f"{d}/benchmark.parquet")).filter("n_hit > 5").count()
    assert again == 0 and clean.columns == docs.columns
    safe = {r.doc_id: r.text for r in corpus_pipeline.without_secrets(spark, clean, d).collect()}
    for i, t in bare.items():
        assert (safe[i] == t) == (not secret_brute(t))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == sorted(safe)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.queries()} >= {*(f"op{n}" for n in range(1, 11)), "pipeline"}
    assert set(queries.oracle_sql()) <= set(queries.queries())
