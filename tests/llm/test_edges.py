"""Nulls, empties, repeats, clashing names and whole results of every operator and of the pipeline, against brute force where SQL cannot say them."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import textwrap
import zlib
from itertools import product

import numpy as np
import pytest

pytest.importorskip("threadloom.llm")
import corpus_pipeline  # noqa: E402
from conftest import SF  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_llm import CASES, brute, docs  # noqa: E402

from threadloom.llm import common, op1_warc, op2_secret_scans, op3_token_counts, op4_chat_formatting, op5_ngram_jaccard, op6_decontamination, op7_language_id, op8_lm_scoring, op9_packing, op10_quality_rules  # noqa: E402, E501

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n string, s string, row long, task int, t string, words string, sig string, ask string, item string"
NONE = [None] * 10


def odd(spark, texts):
    """Rows with nulls everywhere, a null id, repeated ids, and columns named like the operators' own."""
    rows = [(i, t, None, None, *NONE[:11]) for i, t in enumerate(texts)]
    rows += [(None, "a null id is a row too", None, None, *NONE[:11]), (3, "word", None, None, *NONE[:11]), (3, "another text for id three", None, None, *NONE[:11])]
    return spark.createDataFrame([(*r, None)[: len(SCHEMA.split(", "))] for r in rows], SCHEMA)


ITEMS = "item_id long, text string"
OPERATORS = {
    "op2": lambda d: op2_secret_scans.secret_spans(d),
    "op2 redact": lambda d: op2_secret_scans.redact(d),
    "op3": lambda d: op3_token_counts.token_counts(d, P.path("byte_bpe_50k.json")),
    "op5": lambda d: op5_ngram_jaccard.jaccard_components(d),
    "op6": lambda d: op6_decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "some words of an item")], ITEMS)),
    "op7": lambda d: op7_language_id.identify(d, op7_language_id.train(d, "doc_id", "text", "lang")),
    "op8": lambda d: op8_lm_scoring.score(d),
    "op9": lambda d: op9_packing.pack(d, P.path("word_bpe_49k.json")),
    "op10": lambda d: op10_quality_rules.project(d, carry=("doc_id",)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    d = odd(spark, CASES)
    n = d.count()
    got = OPERATORS[name](d)
    rows = got.collect()
    key = "__c_doc_id" if name == "op10" else "doc_id"
    if name == "op9":
        assert sum(r.start == 0 for r in rows) == n
    else:
        assert len(rows) == n
    assert sum(r[key] is None for r in rows) == 1 and sum(r[key] == 3 for r in rows) == 3
    assert OPERATORS[name](d.limit(0)).count() == 0


def test_warc_odd_and_empty(spark):
    schema = "page_id long, url string, html string, payload string, value string, sha string, page long"
    rows = [(1, None, None, *NONE[:4]), (1, "u", "", *NONE[:4]), (None, "u", "x", *NONE[:4]), (2, "u", "x", *NONE[:4]), (2, "u", "y" * 300_000, *NONE[:4]), (3, None, "x", *NONE[:4])]
    d = spark.createDataFrame(rows, schema)
    path = common.scratch(spark, "test")
    op1_warc.write(d, path)
    got = op1_warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got) == sorted((p is None, p or 0, len(h or "")) for p, _, h, *_ in rows)
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert kinds[3, 1] == ("response", None) and kinds[2, 1] == ("revisit", 3)
    path = common.scratch(spark, "test")
    op1_warc.write(d.limit(0), path)
    assert op1_warc.read(spark, path).count() == 0


def test_chat_odd_and_empty(spark):
    schema = "conv_id string, turn long, role string, text string, grp string, kind int, hash string, position long"
    rows = [("a", 0, None, "One two three", "x", 1, "y", 5), ("a", 1, "u", None, *NONE[:4]), ("a", 1, "u", "", *NONE[:4]), ("a", 2, "u", "> one  two THREE\nyes " + "z" * 50_000, *NONE[:4]), (None, 0, "u", "One", *NONE[:4]), ("b", None, "u", "One", *NONE[:4])]
    got = op4_chat_formatting.linked(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by["a", 2].reply_to == 0 and by["a", 1].reply_to == 0 and by["a", 2].depth == 1 and by[None, 0].reply_to is None and by["b", None].position is None
    assert op4_chat_formatting.linked(spark.createDataFrame([], schema)).count() == 0


def test_links_brute_force(spark):
    """Nested and repeated quotations: the latest earlier message that gave a passage; linear in copies and gaps."""
    rng = random.Random(8)
    m = []
    for conv in range(6):
        own = []
        for turn in sorted(rng.sample(range(80), 25)):
            mine, lines = rng.choice(["yes", "no", f"unique words {turn}", "again and again"]), []
            for _ in range(rng.randint(0, 2)):
                if own:
                    q = rng.choice(own)
                    level = rng.randint(1, 3)
                    lines.append("> " * level + q.upper())
                    lines.append("")
            m.append((conv, turn, "u", "\n".join([*lines, mine])))
            own.append(mine)
    got = {(r.conv_id, r.turn): r for r in op4_chat_formatting.linked(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).collect()}
    parsed = {(c, t): op4_chat_formatting.keys_of(x) for c, t, _, x in m}
    for c, t, _, _ in m:
        found = []
        for depth, h in parsed[c, t][2]:
            before = [u for (d, u), k in parsed.items() if d == c and u < t and h in k[1]]
            if before:
                found.append((depth, -max(before), h))
        earlier = [u for d, u in parsed if d == c and u < t]
        want = -min(found)[1] if found else max(earlier, default=None)
        assert got[c, t].reply_to == want and got[c, t].n_linked == len({f[2] for f in found})
    many = [(0, t, "u", "> same words here\nsame words here" if t else "same words here") for t in range(0, 6000, 2)]
    r = op4_chat_formatting.linked(spark.createDataFrame(many, "conv_id long, turn long, role string, text string")).agg(F.count("reply_to"), F.max("depth"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(r) == (2999, 2999, 2999, 3000)


SECRET = "password=abcdef123"


def test_secrets_wrapped_glued_and_broken():
    long = (SECRET + " and prose that goes on, so that lines break; ") * 4
    packed = [gzip.compress(SECRET.encode()), bz2.compress(SECRET.encode()), zlib.compress(SECRET.encode())]
    for text, start, end in [
        ("dir/" + base64.b64encode(SECRET.encode()).decode(), 4, 28), ("x" + base64.b64encode(SECRET.encode()).decode() + " end", 1, 25),
        ("%FF" + SECRET.replace("=", "%3D") + "%C3", 3, 23), *[("a/b/" + base64.b64encode(z).decode(), None, None) for z in packed],
        (textwrap.fill(base64.b64encode(long.encode()).decode(), 76), 0, None), (textwrap.fill(base64.b64encode(long.encode()).decode(), 64) + "\nend of it", 0, None),
        ("\r\n".join(textwrap.wrap(base64.b64encode(gzip.compress("; ".join(str(random.Random(k).random()) for k in range(9)).encode() + SECRET.encode())).decode(), 60)), 0, None),
        (textwrap.fill(base64.b64encode(base64.b64encode(long.encode())).decode(), 76), 0, None),
    ]:
        _, spans, _ = op2_secret_scans.scan(text)
        found = [s for s in spans if s[1] == 0]
        assert found, text[:60]
        assert start is None or any(s[0] == start and (end is None or s[2] == end) for s in found), (text[:60], found)
        assert "abcdef123" not in op2_secret_scans.redacted(text, spans)
    assert op2_secret_scans.scan("Entlichungsvereinigungen und weitere, /usr/local/share/something/else-and_more/words")[1] == []


def base_spans(text):
    """The base rules read plainly: maximal runs, then their lengths."""
    out = []
    for kind, pattern, least in ((0, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), (1, "(AKIA[A-Z0-9]+)", 20), (2, "([0-9a-f]+)", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return sorted(out)


def test_secret_base_brute_force(spark):
    rng = random.Random(2)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCDEFGH1234", "0f" * 13, "deadbeef", "\n", "é", ".", "ſ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for t in texts:
        base, spans, _ = op2_secret_scans.scan(t)
        assert base == base_spans(t) and set(base) <= set(spans)
    got = {r.doc_id: r for r in op2_secret_scans.secret_spans(docs(spark, texts[:200])).collect()}
    for i, t in enumerate(texts[:200]):
        want = base_spans(t)
        assert got[i].base_spans == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want) and got[i].n_hex == sum(s[1] == 2 for s in want)


def test_token_counts_of_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in op3_token_counts.op3_token_counts(spark, SF).collect()}
    for r in common.table(spark, SF, "documents").collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 512)


def linked_sets(spark, texts, k, threshold):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_ngram_jaccard.jaccard_components(docs(spark, texts), k=k, threshold=threshold).collect()}
    return [got[i] for i in range(len(texts))]


def test_jaccard_thresholds_brute_force(spark):
    """Sets of all sizes just above and below the threshold, with a passage that many share, and copies."""
    rng = random.Random(11)
    for k, threshold in ((1, 50), (2, 80), (5, 80), (1, 100)):
        texts = []
        for _ in range(20):
            w = [f"v{rng.randint(0, 10**6)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 150]))]
            common_ = [f"c{i}" for i in range(rng.choice([0, 12]))]
            for _ in range(rng.randint(1, 6)):
                x = list(w)
                for _ in range(rng.randint(0, 1 + len(x) // (4 * k))):
                    x[rng.randrange(len(x))] = f"n{rng.randint(0, 10**6)}"
                texts.append(" ".join([*x, *common_]))
        assert linked_sets(spark, texts, k, threshold) == brute(texts, k, threshold), (k, threshold)


def test_jaccard_parts():
    """Two linked sets that differ always have enough keys in common."""
    rng = np.random.default_rng(3)
    for threshold in (50, 80, 90, 95):
        for n in [*range(1, 40), 77, 150, 400, 1000]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                b = a.copy()
                for _ in range(rng.integers(0, 2 + n * (100 - threshold) // 100)):
                    op = rng.integers(0, 2)
                    b = np.delete(b, rng.integers(0, len(b))) if op and len(b) > 1 else np.union1d(b, rng.integers(0, 2**63, 1, dtype=np.uint64))
                shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 100 * shared < threshold * union or shared == union:
                    continue
                (x, need_x), (y, need_y) = op5_ngram_jaccard.part_keys(a, threshold), op5_ngram_jaccard.part_keys(b, threshold)
                both = np.intersect1d(x, y)
                at = {int(v) & 15 for v in both}
                assert any(sum(int(v) & 15 == i for v in both) >= need_x[i] for i in at) and any(sum(int(v) & 15 == i for v in both) >= need_y[i] for i in at)


def test_tiling_brute_force():
    """Greedy tiling, spelt out: the longest match of free words, first in the item, then in the text, again and again."""

    def plain(a, b, least):
        free_a, free_b, out = [True] * len(a), [True] * len(b), []
        while True:
            best = (0, 0, 0)
            for i, j in product(range(len(a)), range(len(b))):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
            if best[0] < least:
                return sum(t for t, _, _ in out), len(out)
            k, i, j = best[0], -best[1], -best[2]
            free_a[i : i + k] = [False] * k
            free_b[j : j + k] = [False] * k
            out.append((k, i, j))

    rng = random.Random(9)
    for _ in range(400):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 16))] for _ in range(2))
        least = rng.choice([2, 3, 4])
        assert op6_decontamination.coverage(a, b, least) == plain(a, b, min(least, len(a)))


def test_leaks_both_paths(spark):
    rng = random.Random(10)
    items = [(i % 7, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(12)] + [(3, None)]
    texts = [None, ""] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    d = docs(spark, texts).union(docs(spark, texts[:9]))
    bench = spark.createDataFrame(items, ITEMS)
    small, large = (sorted(op6_decontamination.leaks(d, bench, broadcast_words=most).collect()) for most in (10**6, 1))
    want = []
    for i, t in [*enumerate(texts), *enumerate(texts[:9])]:
        for item, x in items:
            a, b = op6_decontamination.words_of(x), op6_decontamination.words_of(t)
            if a and b:
                c, n = op6_decontamination.coverage(a, b)
                if 100 * c >= op6_decontamination.SHARE * len(a):
                    want.append((i, item, len(a), c, n, c / len(a)))
    assert small == large and [tuple(r) for r in small] == sorted(want)
    named = bench.withColumnRenamed("text", "passage")
    kept = {tuple(sorted(map(str, op6_decontamination.decontaminate(d, named, item_text_col="passage", broadcast_words=most).collect()))) for most in (10**6, 1)}
    assert len(kept) == 1


def test_language_decoding():
    """Loss-weighted decoding against its formula, and codewords of many languages that are apart."""
    rng = np.random.default_rng(4)
    code = op7_language_id.codewords(3)
    m = op7_language_id.Model(["a", "b", "c"], code, rng.normal(0, 3, (1 << op7_language_id.BITS, code.shape[1])).astype(np.float32), np.zeros(code.shape[1]), 0.2)
    text = "some text to look at".encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    z = op7_language_id.margins(data, off, m.weights, m.bias)[0]
    losses = [sum(np.log1p(np.exp(-z[b] * code[k][b])) for b in range(code.shape[1])) for k in range(3)]
    pick, score, unsure = m.predict(data, off)
    share = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
    assert pick[0] == int(np.argmin(losses)) and np.isclose(score[0], share.max()) and unsure[0] == (np.sort(share)[-1] - np.sort(share)[-2] < 0.2)
    for k in (9, 30):
        c = op7_language_id.codewords(k)
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= c.shape[1] // 5


def test_tree_few_shared_words(spark, monkeypatch):
    """Words, pairs and triples beyond what all tasks hold are counted and joined by hash: the same scores."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a m x", "b m y", f"r{rng.randint(0, 60)} m x"]) for _ in range(6)) for _ in range(150)]
    whole = {r.doc_id: tuple(r) for r in op8_lm_scoring.score(docs(spark, texts)).collect()}
    for words, pairs in ((0, 0), (3, 5), (1 << 21, 0)):
        monkeypatch.setattr(op8_lm_scoring, "SHARED_WORDS", words)
        monkeypatch.setattr(op8_lm_scoring, "SHARED_PAIRS", pairs)
        few = {r.doc_id: tuple(r) for r in op8_lm_scoring.score(docs(spark, texts)).collect()}
        assert all(few[i] == pytest.approx(whole[i], abs=1e-6) for i in whole) and len(few) == len(whole)


def test_best_fill_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        window = rng.choice([8, 13, 16, 20, 32])
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, window), rng.randint(1, min(5, window - 1)))}
        first = max(counts)
        left = {n: c - (n == first) for n, c in counts.items() if c - (n == first)}
        total, used = op9_packing.best_fill(left, first, window)
        sums = {first + sum(n * k for n, k in zip(left, ks, strict=True)) for ks in product(*[range(c + 1) for c in left.values()])}
        want = min((op9_packing.padding(t, window), -t) for t in sums if t <= window)
        assert (op9_packing.padding(first + total, window), -(first + total)) == want
        assert sum(n * k for n, k in used) == total and all(0 < k <= left[n] for n, k in used)


def test_packing_is_tight(spark):
    rng = random.Random(6)
    texts = [" ".join("word" for _ in range(rng.randint(0, 150))) for _ in range(300)]
    rows = op9_packing.pack(docs(spark, texts).repartition(7), P.path("word_bpe_49k.json"), window=64).collect()
    totals = {}
    for r in rows:
        totals[r.sequence_id] = totals.get(r.sequence_id, 0) + r.length
    padded = sum(op9_packing.padding(t, 64) for t in totals.values())
    assert sorted(totals) == list(range(len(totals))) and padded <= sum(totals.values()) // 100


def test_quality_sql_follows_rules():
    assert all(f"THEN '{r.name}' END" in op10_quality_rules.SQL for r in op10_quality_rules.RULES)


def test_pipeline_brute_force(spark, tmp_path):
    """run() over planted copies, benchmark passages and secrets, against plain Python, stage by stage."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "to", f"w{rng.randint(0, 10**6)}"]) for _ in range(n))
    passage = " ".join(f"q{i}" for i in range(30))
    base = [prose(80) for _ in range(12)]
    near = [" ".join([*b.split()[:-1], "changed"]) for b in base[:4]]
    texts = [
        *base, *near, base[0], base[1], "short text", None, "", f"{prose(60)} {passage} {prose(10)}", f"{prose(60)} {' '.join(passage.split()[15:])} x {' '.join(passage.split()[:15])}",
        f"{prose(70)} {SECRET}", f"{prose(70)} {base64.b64encode(SECRET.encode()).decode()} {'ab' * 15}", " ".join(["same"] * 100), "# * $ % " * 30 + prose(60),
    ]
    ids = [*range(100, 100 + len(texts))]
    rng.shuffle(ids)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[5], (rows[6][0], rows[6][1], "x", "y", 1), (None, base[7], "en", "s", 1), (None, prose(90), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, " ")], ITEMS).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    # quality rules, spelt out
    kept = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        lines = [x for x in (r[1] or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        repeat = len({k + d for k, x in enumerate(g) if g.count(x) > 1 for d in range(3)})
        m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in r[1] or ""), "n_stop": sum(x.lower() in op10_quality_rules.STOP_WORDS for x in w), "n_lines": len(lines), "n_bullets": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines),
             "n_ellipses": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat}
        ratio = lambda q, m=m: m[q.numerator] / (m[q.denominator] if q.denominator else 1)
        if len(w) >= 50 and 2 * repeat <= len(w) and all(q.low <= ratio(q) <= q.high for q in op10_quality_rules.RULES if not q.denominator or m[q.denominator]):
            kept.append(r)
    # near duplicates: one of each group
    comp = brute([r[1] for r in kept], 5, 80)
    groups = {}
    for r, (_, c) in zip(kept, comp, strict=True):
        groups.setdefault(c, []).append(r)
    one = {}
    for g in groups.values():
        named = [r for r in g if r[0] is not None] or g
        smallest = min((r[0] for r in named if r[0] is not None), default=None)
        one[smallest, len(one) if smallest is None else 0] = {r[1] for r in named if r[0] == smallest}
    clean = {k: {t for t in v if op6_decontamination.coverage(passage.split(), op6_decontamination.words_of(t))[0] < 0.6 * 30} for k, v in one.items()}
    clean = {k: v for k, v in clean.items() if v}
    # secrets and packing
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for (i, _), v in clean.items():
        options = set()
        for x in v:
            x = op2_secret_scans.redacted(x, op2_secret_scans.scan(x)[1])
            assert "abcdef123" not in x
            options.add(zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()))
        want.setdefault(i, []).append(options)
    assert len(got) == sum(map(len, want.values())) and all(r.start == 0 and r.length == r.doc_tokens for r in got)
    for r in got:
        match = next(o for o in want[r.doc_id] if r.ids_crc32 in o)
        want[r.doc_id].remove(match)
    assert len(clean) < len(one) and len(one) < len(kept) < len(rows) and hashlib.md5(b"").hexdigest()
    totals = {}
    for r in got:
        totals.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in totals.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_stages_on_empty(spark):
    d = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, SF).count() == 0
