"""Small cases with a defined result for each operator, and brute-force comparisons."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("threadloom.llm")
import corpus_pipeline  # noqa: E402
from conftest import SF  # noqa: E402

from threadloom.llm import common, op1_warc, op2_secret_scans, op3_token_counts, op4_chat_formatting, op5_ngram_jaccard, op6_decontamination, op7_language_id, op8_lm_scoring, op9_packing, op10_quality_rules  # noqa: E402, E501

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, tokens string, kept string"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


CASES = [None, "", " \n\t", "word", "word", "a b c d e f g h " * 3000, "x" * 50_000, "\U0001f600 é\x1c\x85"]


def test_quality_edges(spark):
    out = op10_quality_rules.project(docs(spark, CASES), carry=("doc_id",)).collect()
    by = {r["__c_doc_id"]: r for r in out}
    assert by[0]["__n_words"] == by[1]["__n_words"] == by[2]["__n_words"] == 0 and by[0]["__base_failed"] and not by[0]["__kept"]
    assert by[5]["__n_words"] == 24_000 == by[5]["__n_repeat_words"]
    assert op10_quality_rules.apply_rules(docs(spark, CASES)).columns == docs(spark, []).columns
    assert op10_quality_rules.project(docs(spark, []), carry=("doc_id",)).count() == 0


def test_repeat_words_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    got = {r["__c_doc_id"]: r["__n_repeat_words"] for r in op10_quality_rules.project(docs(spark, texts), carry=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({k + d for k, x in enumerate(g) if g.count(x) > 1 for d in range(3)})


def test_warc_round_trip(spark):
    fake = op1_warc.record(99, "http://f", b"inner", op1_warc.digest_of(b"inner"), None).decode() + "\n"
    payloads = [None, "", "hello", "hello", fake, "x" + fake * 3 + "WARC/1.0\r\n", "WARC/1.WARC/1.0\r\n\r\n", "é" * 70_000, "hello", "\r\n\r\n\n"]
    df = spark.createDataFrame([(i, "http://a\r\nb", p, "q") for i, p in enumerate(payloads)], "page_id long, url string, html string, payload string").repartition(2)
    path = common.scratch(spark, "test")
    op1_warc.write(df, path)
    got = {r.page_id: r for r in op1_warc.read(spark, path).collect()}
    assert sorted(got) == list(range(len(payloads)))
    data = [(p or "").encode() for p in payloads]
    for i, d in enumerate(data):
        keeper = max(k for k, e in enumerate(data) if e == d)
        want = (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if keeper == i else "revisit", None if keeper == i else keeper)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want and got[i].digest_ok


def test_warc_records_without_python(spark):
    payloads = [None, "", "hello", "hello", "hello", "é\x00\x7f%", "é\x00\x7f%", "x" * 5000, "z", "z"]
    ids = [0, 1, 2, None, 3, -5, 4, 6, None, None]
    urls = [None, "".join(map(chr, range(0x82))), "http://a\r\nb", "é 日\x7f", "", "%41", "a b", "c", "d", "e"]
    df = spark.createDataFrame([*zip(ids, urls, payloads, strict=True)], "page_id long, url string, html string").repartition(3)
    for least in (0, 6):
        made = op1_warc.records(df, least=least)
        assert "Arrow" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "Python" not in plan
        want = []
        for i, u, p in zip(ids, urls, payloads, strict=True):
            d = (p or "").encode()
            keeper = max((k for k, q in zip(ids, payloads, strict=True) if (q or "") == (p or "") and k is not None), default=None)
            want.append(op1_warc.record(i, u, d, op1_warc.digest_of(d), keeper if keeper != i and len(d) >= least else None))
        assert sorted(bytes(r.value) for r in made.collect()) == sorted(want)


def test_secrets_layers():
    secret = "password=abcdef123"
    assert op2_secret_scans.joined(op2_secret_scans.scan(f"x {secret}")[1]) == "assign:2:20"
    for wrapped in (
        base64.b64encode(secret.encode()).decode(),
        base64.b64encode(gzip.compress(secret.encode())).decode(),
        base64.b64encode(base64.b64encode(zlib.compress(secret.encode()))).decode(),
        secret.replace("=", "%253D"),
        secret.replace("=", "\\u003d"),
        gzip.compress(secret.encode()).hex(),
    ):
        base, spans, _ = op2_secret_scans.scan(f"see {wrapped} end")
        assert any(s[1] == 0 and s[0] == 4 and s[2] == 4 + len(wrapped) for s in spans), wrapped
        assert "abcdef123" not in op2_secret_scans.redacted(f"see {wrapped} end", spans)
    assert op2_secret_scans.scan("")[1] == [] and op2_secret_scans.scan("token=abc")[1] == []


def test_secrets_edges(spark):
    got = op2_secret_scans.secret_spans(docs(spark, CASES)).collect()
    assert len(got) == len(CASES) and all(r.spans == "" for r in got)


def test_token_counts_against_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    c = op3_token_counts.compiled(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    letters = [*"abthe  \n\t's'll.,!?123é  \x1c\x85́日😀", "<|endoftext|>", " the", "'re"]
    for _ in range(1500):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert c.count(x, rng.choice([3, 7, 65536])) == len(t.encode(x, add_special_tokens=False).ids), x


def test_quote_links(spark):
    m = [(1, 0, "u", "Hello there"), (1, 1, "a", "Other thing"), (1, 2, "u", "> hello   THERE\nmy answer"), (1, 3, "a", ">> Hello there\n> my answer\nyes"), (1, 5, "u", None), (None, 0, "u", "x"), (2, 0, "u", "> nothing")]
    got = {(r.conv_id, r.turn): r for r in op4_chat_formatting.linked(spark.createDataFrame(m, "conv_id long, turn int, role string, text string")).collect()}
    assert len(got) == 7
    assert (got[1, 2].reply_to, got[1, 2].text, got[1, 2].depth) == (0, "my answer", 1)
    assert (got[1, 3].reply_to, got[1, 3].n_linked, got[1, 3].depth, got[1, 3].text) == (2, 2, 2, "yes")
    assert (got[1, 5].reply_to, got[1, 5].thread) == (3, 0) and got[2, 0].reply_to is None and got[2, 0].text == ""


def brute(texts, k, threshold):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def test_jaccard_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))] for _ in range(12)]
    texts = [None, "", " ", "one", "one"]
    for _ in range(150):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = f"w{rng.randint(0, 400)}"
        texts.append(" ".join(b))
    for k, threshold in ((3, 90), (2, 70)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_ngram_jaccard.jaccard_components(docs(spark, texts), k=k, threshold=threshold).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, k, threshold)


def test_jaccard_empty(spark):
    assert op5_ngram_jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_tiling_reordered(spark):
    item = " ".join(f"q{i}" for i in range(20))
    half = item.split()
    texts = [f"before {item} after", " ".join(["x", *half[10:], "y", *half[:10]]), " ".join(half[:6]) + " other", None, "", "unrelated words only here"]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    for most in (op6_decontamination.BROADCAST_WORDS, 1):
        got = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in op6_decontamination.leaks(docs(spark, texts), bench, broadcast_words=most).collect()}
        assert got == {(0, 7): (20, 1), (1, 7): (20, 2)}
    assert {r.doc_id for r in op6_decontamination.decontaminate(docs(spark, texts), bench).collect()} == {2, 3, 4, 5}


def test_language_held_out(spark):
    d = common.table(spark, SF, "documents")
    got = op7_language_id.op7_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in got)
    edge = op7_language_id.identify(docs(spark, CASES), op7_language_id.train(d, "doc_id", "text", "lang")).collect()
    assert [r.lang_pred for r in sorted(edge, key=lambda r: r.doc_id)[:3]] == ["und"] * 3
    assert op7_language_id.identify(docs(spark, ["abc"]), None).first().lang_pred == "und"


def test_language_codes():
    for k in (2, 4, 9):
        c = op7_language_id.codewords(k)
        assert len({tuple(r) for r in c.tolist()}) == k


def test_tree_brute_force(spark, monkeypatch):
    """Scores against a plain suffix tree over lists, with all entries shared and with most of them joined."""
    import math
    from collections import Counter

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    texts = CASES[:5] + [" ".join(vocab[min(11, int(rng.expovariate(0.4)) + (j % 3))] for j in range(rng.randint(1, 40))) for _ in range(400)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    rows = [(re.findall(r"[^\x20\x09-\x0D]+", t or "") + ["$"]) for t in texts]
    one, two, three = Counter(), Counter(), Counter()
    for w, h in zip(rows, held, strict=True):
        if not h:
            one.update(w)
            two.update(zip(["$", *w], w, strict=False))
            three.update(zip(["$", *w], w, w[1:], strict=False))
    z = sum(one.values()) + len(one) + 1

    def law(level, contexts, counts, lower):
        out = {}
        by = {}
        for key, c in counts.items():
            by.setdefault(key[:-1], {})[key[-1]] = c
        for s, after in by.items():
            n = contexts[s]
            if n < op8_lm_scoring.LEAST[level] or level == 2 and s[1:] not in laws1:
                continue
            after = {b: c for b, c in after.items() if c >= op8_lm_scoring.ENTRY}
            k = max(1, len(after) + n - sum(after.values()))
            p = {b: (c + k * lower(s, b)) / (n + k) for b, c in after.items()}
            if not p:
                continue
            bow = (1 - sum(p.values())) / (1 - sum(lower(s, b) for b in p))
            gain = sum(after[b] * math.log(p[b] / lower(s, b)) for b in p) + (n - sum(after[b] for b in p)) * math.log(bow)
            if gain > op8_lm_scoring.GAIN:
                out[s] = (p, bow)
        return out

    def root(s, b):
        return (one[b] + 1) / z

    laws1 = law(1, {(w,): n for w, n in one.items()}, two, root)

    def first(s, b):
        p, bow = laws1.get(s[-1:], ({}, 1))
        return p[b] if b in p else bow * root(s, b)

    laws2 = law(2, two, three, first)

    def second(s, b):
        p, bow = laws2.get(s, ({}, 1))
        return p[b] if b in p else bow * first(s, b)

    assert laws1 and laws2
    want = []
    for w in rows:
        h = ["$", *w]
        want.append(sum(math.log10(first((h[j],), b) if j == 0 else second((h[j - 1], h[j]), b)) for j, b in enumerate(w)))
    got = {r.doc_id: r for r in op8_lm_scoring.score(docs(spark, texts)).collect()}
    assert [got[i].held_out for i in range(len(texts))] == held
    assert all(math.isclose(got[i].score, x, abs_tol=1e-3) for i, x in enumerate(want))
    assert all(math.isclose(got[i].base_score, sum(math.log10(root((), b)) for b in w), abs_tol=1e-6) for i, w in enumerate(rows))
    for s, (p, bow) in [*laws1.items(), *laws2.items()]:
        low = root if len(s) == 1 else first
        assert math.isclose(sum(p.values()) + bow * (1 - sum(low(s, b) for b in p)), 1)
    # the tree with few shared pairs: those that stay contexts differ, the entries of level 1 do not
    monkeypatch.setattr(op8_lm_scoring, "SHARED_PAIRS", 30)
    few = op8_lm_scoring.score(docs(spark, texts)).collect()
    assert sum(r.score for r in few) > sum(r.base_score for r in few) and len(few) == len(texts)


def test_tree_joined_entries(spark, monkeypatch):
    """Level 1 alone, all entries shared or all joined: equal scores."""
    import math

    texts = [*CASES, *["the cat sat on the mat and the dog sat on the cat"] * 60, *["a cat and a dog"] * 30]
    monkeypatch.setattr(op8_lm_scoring, "count_level", lambda train, tree, level, f=op8_lm_scoring.count_level: f(train, tree, level).where(f"{level} = 1"))
    whole = {r.doc_id: r.score for r in op8_lm_scoring.score(docs(spark, texts)).collect()}
    monkeypatch.setattr(op8_lm_scoring, "SHARED_PAIRS", 0)
    joined = {r.doc_id: r.score for r in op8_lm_scoring.score(docs(spark, texts)).collect()}
    assert {i: (whole[i], joined[i]) for i in whole if not math.isclose(joined[i], whole[i], rel_tol=1e-4, abs_tol=1e-3)} == {}
    assert len(whole) == len(texts)
    assert all(r.score < 0 for r in op8_lm_scoring.score(docs(spark, CASES)).collect())
    assert op8_lm_scoring.score(docs(spark, [])).count() == 0


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*CASES, *[f"some words {i} " * (i % 40) for i in range(120)]]
    rows = op9_packing.pack(docs(spark, texts), P.path("word_bpe_49k.json"), window=64).collect()
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    used = {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_pipeline_columns(spark):
    d = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, d, SF)
        assert new.columns == d.columns, name
        d = common.materialise(new, "test")
    out = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    kept = {r.doc_id for r in d.select("doc_id").collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept and kept


def test_tree_contexts_beyond_shared(spark, monkeypatch):
    """Every pair of enough occurrences is a context, whatever is shared: scores do not depend on what all tasks hold."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a m x", "b m y"]) for _ in range(6)) for _ in range(100)]  # what follows m depends on the word before
    whole = {r.doc_id: (r.score, r.base_score, r.n_known) for r in op8_lm_scoring.score(docs(spark, texts)).collect()}
    for shared in (0,):
        monkeypatch.setattr(op8_lm_scoring, "SHARED_PAIRS", shared)
        few = {r.doc_id: (r.score, r.base_score, r.n_known) for r in op8_lm_scoring.score(docs(spark, texts)).collect()}
        assert len(few) == len(texts) and all(few[i] == pytest.approx(whole[i], abs=1e-3) for i in whole)


def test_tree_small_contexts(spark):
    """A context of 10 occurrences whose follower is always the same has a law of its own."""
    texts = [f"x{i} y{i} z{i}" for i in range(60)] + ["alpha beta gamma"] * 12
    got = [r for r in op8_lm_scoring.score(docs(spark, texts)).collect() if r.doc_id >= 60]
    trained = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(60, 72))
    assert 8 <= trained < 16 and all(r.score > r.base_score + 2 for r in got)


def test_secrets_members_and_long_blobs():
    import bz2
    import lzma

    secret = b"password=abcdef123"
    filler = b"".join(b"line %d, of prose \xc3\xa9\n" % i for i in range(40_000))
    binary = bytes(random.Random(1).randbytes(1 << 17))
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        for blob in (pack(b"first, ") + pack(secret), pack(filler + secret), pack(binary + b"\n" * 70_000 + secret), pack(pack(b"a, ") + pack(secret)), pack(b"first, ") + b", " + secret):
            run = base64.b64encode(blob).decode()
            _, spans, _ = op2_secret_scans.scan(f"see {run} end", 1 << 18)
            assert any(s[1] == 0 and s[0] == 4 and s[2] == 4 + len(run) for s in spans)
    plain = (filler + secret).decode()
    parts = list(op2_secret_scans.blobs(gzip.compress(plain.encode()), 1 << 17))
    assert "".join(parts) == plain and len(parts) > 2 and max(map(len, parts)) < 1 << 18
    quine_like = gzip.compress(b"x" * 10)
    assert list(op2_secret_scans.blobs(quine_like[:-9], 1 << 18)) in ([], ["x" * 10])


def test_reply_order(spark):
    """Positions are the pre-order of the reply tree: a late answer to an early message stands below it."""
    rng = random.Random(6)
    m, want = [], {}
    for conv in range(8):
        turns = sorted(rng.sample(range(60), rng.randint(1, 30)))
        parent = {}
        for k, t in enumerate(turns):
            quoted = rng.choice(turns[:k]) if k and rng.random() < 0.5 else None
            parent[t] = quoted if quoted is not None else turns[k - 1] if k else None
            m.append((conv, t, "u", f"message {t}" if quoted is None else f"> message {quoted}\nmessage {t}"))
        order, stack = [], [turns[0]]
        while stack:
            t = stack.pop()
            order.append(t)
            stack += sorted((c for c, p in parent.items() if p == t), reverse=True)
        want |= {(conv, t): (k, parent[t]) for k, t in enumerate(order)}
    got = op4_chat_formatting.linked(spark.createDataFrame(m, "conv_id long, turn int, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.position, r.reply_to) for r in got} == want
    assert any(sorted(k for k in want if k[0] == c) != sorted((k for k in want if k[0] == c), key=lambda k: want[k][0]) for c in range(8))


def test_decontaminate_both_branches(spark):
    """Null and repeated ids, and a benchmark of mostly blank rows: the same rows stay, however large the benchmark counts."""
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, f"a {item} b"), (None, "clean text"), (1, f"{item} c"), (1, "clean too"), (2, None), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ")] * 60 + [(7, item)], "item_id long, text string").coalesce(1)
    for most in (op6_decontamination.BROADCAST_WORDS, 30, 1):
        kept = op6_decontamination.decontaminate(d, bench, broadcast_words=most)
        assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in d.collect() if item not in (r.text or ""))


def test_lm_counts_go_in_blocks(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 3000) for _ in range(60)]
    rows = docs(spark, texts).select("text").repartition(3)
    got = op8_lm_scoring.count_words(rows)
    before = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in before and "bucket" in before and "size" in before
    want = Counter(int(k) for t in texts for k in op8_lm_scoring.symbols(pa.array([t]))[1])
    assert {r.key: r.n for r in got.collect()} == want and max(want.values()) > 255 and min(want) < 0
    for parts in (1, 49, 70_001):
        s = np.unique(rng.integers(-(2**63), 2**63, 5000).view(np.uint64))
        n, b = rng.integers(1, 2**40, len(s)), rng.integers(-(2**63), 2**63, len(s))
        key = rng.integers(-(2**63), 2**63, len(s))
        for more in ((), (key, b)):
            out = {}
            for x in op8_lm_scoring.blocks_of(s, n, parts, *more).to_pylist():
                value = np.cumsum(op8_lm_scoring.numbers(x["s"], x["size"])) + np.uint64(x["first"] % 2**64)
                value = value if more else value * np.uint64(parts) + np.uint64(x["bucket"])
                other = op8_lm_scoring.numbers(x["b"], x["size"]).view(np.int64) if more else np.full(x["size"], -1)
                out |= {int(k): (int(o), int(c), x["bucket"]) for k, o, c in zip(value, other, op8_lm_scoring.numbers(x["n"], x["size"]), strict=True)}
            by = key.view(np.uint64) if more else s
            assert out == {int(k): (int(o), int(c), int(h) % parts) for k, o, c, h in zip(s, b if more else np.full(len(s), -1), n, by, strict=True)}


def test_lm_asked_keys_are_packed_and_answered_in_goes(spark, monkeypatch):
    """Blocks of asked keys are sorted and packed, their copies in the shuffle are parts of them, tables have what is read again; scores stay."""
    rng = np.random.default_rng(6)
    texts = [*CASES, *[" ".join(f"w{x}" for x in rng.zipf(1.4, 300) % 500) for _ in range(80)]]
    d = docs(spark, texts).coalesce(2)
    whole = {r.doc_id: (r.n_known, r.base_score, r.score) for r in op8_lm_scoring.score(d).collect()}
    seen = {}

    def spy(df, tag, f=op8_lm_scoring.materialise):
        out = f(df, tag)
        if tag in ("rows", "laws"):
            seen.setdefault(tag, []).append(out.toPandas())
        elif tag == "sums":
            seen.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(op8_lm_scoring, "materialise", spy)
    for name, x in (("SHARED_WORDS", 20), ("SHARED_STATES", 5), ("SHARED_PAIRS", 0), ("BUCKET", 1000)):
        monkeypatch.setattr(op8_lm_scoring, name, x)
    few = {r.doc_id: (r.n_known, r.base_score, r.score) for r in op8_lm_scoring.score(d).collect()}
    assert len(few) == len(texts) and all(few[i] == pytest.approx(whole[i], abs=1e-6) for i in whole)
    asked = seen["rows"][0].dropna(subset=["bucket"])
    assert len(seen["sums"]) > 1 and min(seen["sums"]) > 0
    assert asked["keys"].map(len).sum() + asked["rows"].map(len).sum() < 9 * asked["size"].sum()
    one, two = seen["laws"]
    assert one["s"].notna().sum() == one["bow"].notna().sum() == one["s"].nunique() and 0 < one["b"].notna().sum() < len(one)
    assert len(two) and two["law"].isna().all() and two["b"].isna().all()
    for parts in (1, 49, 70_001):
        key = rng.integers(-(2**63), 2**63, 3000)
        order, cut, columns = op8_lm_scoring.dealt_keys(key, parts)
        back = np.concatenate([op8_lm_scoring.keys_of(*x, parts) for x in zip(*(c.to_pylist() for c in columns), strict=True)])
        assert (back == key[order]).all() and len(cut) == len(columns[0]) + 1
        assert sorted(order) == list(range(len(key))) and (key[order].view(np.uint64) % np.uint64(parts) == np.repeat(columns[0].to_numpy(), np.diff(cut)).astype(np.uint64)).all()
