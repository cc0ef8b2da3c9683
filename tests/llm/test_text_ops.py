"""Secrets, packing, HTML and scores against brute force and on odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlytics.llm import automaton, html_text, packing, ppm, secrets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string, score string"
ODD = [(1, None, "a", "x"), (2, "", "b", "x"), (3, " \n\t ", "c", "x"), (4, "one", "d", "x"), (4, "one", "d", "x"),
       (None, "no id here", "e", "x"), (5, "word " * 30_000, "f", "x"), (6, "Ünïcödé ſ K İ é. a,b ...", "g", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- automaton and secrets ----------------------------------------------

PIECES = st.lists(st.sampled_from([
    "password", "token=", "api_key: ", "API-KEY", "secret", '"', "'", " ", "=", ":", "AKIA", "ABCDEF0123456789", "deadbeef01234567",
    "abcdef", "0" * 15, "é", "\n", ",", "-----BEGIN ", "RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-" + "1" * 22, "x" * 12, ".", "ſ"]), max_size=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES.map("".join), min_size=1, max_size=4))
def test_spans_equal_plain_expressions(texts):
    rules = secrets.RULES
    exprs = [re.compile(r.regex, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
    found = secrets.find_spans(pa.array(texts), rules, secrets.automaton(rules), exprs)
    for text, spans in zip(texts, found):
        want = sorted((s, k, e) for k, r in enumerate(rules) for s, e in secrets._spans(exprs[k], r, text))
        assert [(s, k, e) for s, e, k in spans] == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcx,", max_size=60), st.integers(1, 9))
def test_automaton_accepts_where_a_rule_ends(text, lane):
    rules = [("ab+c", False), ("(a|b){2,3}x", True), ("cx?c", False)]
    a = automaton.compile_rules(rules)
    at, mask = automaton.scan(a, np.frombuffer(text.encode(), np.uint8), lane)
    got = {(int(p), k) for p, m in zip(at, mask) for k in range(3) if m >> k & 1}
    want = {(e - 1, k) for k, (r, f) in enumerate(rules) for s in range(len(text)) for e in range(s + 1, len(text) + 1)
            if re.fullmatch(r, text[s:e], re.I if f else 0)}
    assert got == want


def test_minimal_automaton():
    a = automaton.compile_rules([("ab|cb", False)])
    assert a.states == 3                       # start, after a or c, accepted


def test_bad_patterns():
    for p in ("a(b", "a)", "a{2", "a.b", ""):
        with pytest.raises(ValueError):
            automaton.compile_rules([(p, False)])


def test_secrets_query_on_odd_rows(spark, odd, documents):
    for docs in (odd, documents):
        rows = secrets.digests(secrets.scan_secrets(docs)).collect()
        want = sorted(((d["doc_id"] is None, d["doc_id"] or 0, *secrets.brute_force(d["text"])[0].values(), secrets.brute_force(d["text"])[1])
                       for d in docs.select("doc_id", "text").collect()))
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows)
        assert got == want
    empty = secrets.digests(secrets.scan_secrets(odd.limit(0))).collect()
    assert empty == []


def test_redaction_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a token = abcdefghijklmnop, b", 29, "k"), (2, None, 0, "k"), (3, "clean", 5, "k")],
                                 "doc_id long, text string, n_chars long, kind string")
    rows = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert rows[1]["text"] == "a [ASSIGN], b" and rows[1]["n_chars"] == 13
    assert rows[2]["text"] is None and rows[3]["text"] == "clean" and rows[3]["kind"] == "k"


# ---- packing --------------------------------------------------------------

def check_packing(docs, rows, limit=2048):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocab_path())
    ids = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r["doc_id"]].append(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    own, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(own) == set(ids)
    for d, texts in ids.items():
        if len(texts) == 1 or len({tuple(t) for t in texts}) == 1:
            pieces = sorted(own[d], key=lambda r: r["start"])
            assert sum(p["length"] for p in pieces) == sum(map(len, texts))
            for p in pieces:
                part = np.array(texts[0][p["start"]:p["start"] + p["length"]], np.uint32)
                assert len(part) == p["length"] and p["doc_tokens"] == len(texts[0])
                assert zlib.crc32(part.astype("<u4").tobytes()) == p["ids_crc32"]
            if len(texts) == 1:
                assert [p["start"] for p in pieces] == list(np.cumsum([0] + [p["length"] for p in pieces[:-1]]))
    pad = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limit
        pad += 0 if at & (at - 1) == 0 else limit - at
    return pad


def test_packing_is_exact(spark, odd, documents):
    for docs in (odd, documents):
        rows = packing.pack_documents(docs).collect()
        assert check_packing(docs, rows) == 0
    assert packing.pack_documents(odd.limit(0)).collect() == []


def test_steps_are_balanced(spark, documents):
    rows = packing.pack_documents(documents.coalesce(1)).groupBy("step_id").agg({"length": "sum", "sequence_id": "count"}).collect()
    sums = sorted(r["sum(length)"] for r in rows)
    assert sums[-1] <= 2048 * packing.STEP_SEQUENCES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=40))
def test_packer_loses_no_id(lengths):
    p = packing.Packer()
    out = []
    docs = [(i, np.arange(n, dtype=np.uint32)) for i, n in enumerate(lengths)]
    out += p.pack(docs[:20]) + p.pack(docs[20:], last=True)
    got = collections.defaultdict(list)
    for tier, seq in out:
        total = sum(n for _, n in seq)
        assert total == tier                    # every window is full
        for (doc, start, ids), n in seq:
            got[doc].append((start, ids[:n].tolist()))
    for i, n in enumerate(lengths):
        assert [x for _, part in sorted(got[i]) for x in part] == list(range(n))


def test_special_tokens_and_odd_words():
    t = packing.WordTokenizer()
    texts = ["<|endoftext|> hi", "don't stop's  x\t\ty", "İstanbul, Ü. 12.5,3 .. , .", "Σας ΣΑΣ", "á b́", "x\x1cy \x85z", None, "é. É.",
             "a.", ".a", "a.b. c", "ʻokina ª"]
    ids, off = t.encode(pa.array(texts))
    for i, x in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == t.tok.encode(x or "", add_special_tokens=False).ids + [1]


# ---- HTML -----------------------------------------------------------------

GOOD = "This is the long text of the page and it has all that is to be in the result, as it is what we want of it and for this it goes on for quite a while."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("body, want", [
    (f"<nav><a href=a>Home</a></nav><article><h1>A &amp; B</h1><p>{GOOD}<p>Short.</p></article><footer>x</footer>", f"A & B\n{GOOD}\nShort."),
    (f"<div class='sidebar'><p>{GOOD}</p></div><main><p>{GOOD}  \n x</p></main>", f"{GOOD} x"),
    (f"<div id=content><h2>Head</h2><p>{GOOD}</p><p>Short one.</p><p>{GOOD}</p></div><div id='comments'><p>{GOOD}</p></div>",
     f"Head\n{GOOD}\nShort one.\n{GOOD}"),
    (f"<article><p>{GOOD}</p><form><input><p>{GOOD}</p></form><aside>{GOOD}</aside><script>var a='</p>';</script><!-- {GOOD} --></article>", GOOD),
    (f"<article><p>1 &lt; 2 &#x41;&#66;&nbsp;c</p><ul><li>x<li>y</ul></article>", "1 < 2 AB c\nx\ny"),
    (f"<article><p>a<b>b</b>c<br>d</p></article><div class='cookie-notice'><p>{GOOD}</p></div>", "abc d"),
    ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>", ""),
])
def test_main_text(body, want):
    assert html_text.extract(page(body)) == want


def test_short_blocks_inherit_from_neighbours():
    good, bad = f"<p>{GOOD}</p>", "<p><a href=x>" + "many links here " * 8 + "</a></p>"
    assert html_text.extract(page(f"<div>{good}<p>Between.</p>{good}</div>")) == f"{GOOD}\nBetween.\n{GOOD}"
    assert html_text.extract(page(f"<div>{bad}<p>Between.</p>{bad}{good}</div>")) == GOOD


def test_linked_titles_and_references_of_an_article_stay():
    body = f"<article><h1><a href=t>Title</a></h1><p>{GOOD}</p><ul><li><a href=r>A reference</a></li></ul><p>See <a href=s>this one</a>.</p></article>"
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>"
    assert html_text.extract(page(menu + body + menu)) == f"Title\n{GOOD}\nA reference\nSee this one."


def test_html_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p", "x"), (3, "u", "<p", "x"), (None, "u", "&bogus; <<>>", "x"),
                                   (5, "u", "<article>" + "<p>a b</p>" * 20_000, "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract_text(pages).collect()
    assert len(rows) == 6
    by = {r["page_id"]: r for r in rows}
    assert by[1]["text"] == "" and by[1]["n_chars"] == 0 and by[2]["text"] == ""
    assert by[5]["n_chars"] == 4 * 20_000 - 1
    assert html_text.extract_text(pages.limit(0)).collect() == []


def test_pages_give_their_article(spark):
    import html
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert html_text.extract(r["html"]) == "\n".join(p for p in parts if p)


# ---- language-model scores --------------------------------------------------

def brute_log10(train, text, symbol, inner, order):
    """PPM with escape D and exclusion by dictionaries, one byte at a time."""
    counts = collections.defaultdict(collections.Counter)

    def seq(t):
        return [0] * order + [int(symbol[b]) for b in t.encode()] + [0]
    for t in train:
        s = seq(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k:i])][s[i]] += 1
    s, total = seq(text), 0.0
    for i in range(order, len(s)):
        out, done = set(), False
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts.get(tuple(s[i - k:i]), {}).items() if x not in out}
            if not c:
                continue
            t = sum(c.values())
            if s[i] in c:
                total += math.log10((c[s[i]] - 0.5) / t)
                done = True
                break
            total += math.log10(0.5 * len(c) / t)
            out |= set(c)
        if not done:
            total -= math.log10(64 - len(out))
    return total + sum(inner[b] for b in text.encode() if symbol[b] == ppm.RARE)


TRAIN = ["the cat sat on the mat", "the dog sat", "", "a cat and a dog", "étude de la mer"]


def test_trie_equals_dictionaries():
    hist = np.bincount(np.frombuffer("".join(TRAIN).encode(), np.uint8), minlength=256)
    symbol, inner = ppm.symbol_map(hist)
    raw, off = ppm.text_buffers(pa.array(TRAIN))
    cells, counts = np.unique(ppm.gram_index(raw, off, symbol)[0], return_counts=True)
    levels = {ppm.ORDER: (cells, counts)}
    for k in range(ppm.ORDER - 1, -1, -1):
        levels[k] = ppm.shorter(*levels[k + 1], k)
    trie = ppm.Trie([levels[k][0] for k in range(ppm.ORDER + 1)], [levels[k][1] for k in range(ppm.ORDER + 1)])
    for text in ["the cat", "", "zebra", "a mat and the étude", "THE SEA \U0001F600", "qqq"]:
        raw, off = ppm.text_buffers(pa.array([text]))
        cell, _ = ppm.gram_index(raw, off, symbol)
        u, inv = np.unique(cell, return_inverse=True)
        got = trie.logs(u)[inv].sum() + sum(inner[b] for b in text.encode() if symbol[b] == ppm.RARE)
        assert got == pytest.approx(brute_log10(TRAIN, text.lower(), symbol, inner, ppm.ORDER), abs=1e-9)


def test_trie_is_a_distribution():
    hist = np.bincount(np.frombuffer("".join(TRAIN).encode(), np.uint8), minlength=256)
    symbol, _ = ppm.symbol_map(hist)
    raw, off = ppm.text_buffers(pa.array(TRAIN))
    cells, counts = np.unique(ppm.gram_index(raw, off, symbol)[0], return_counts=True)
    levels = {ppm.ORDER: (cells, counts)}
    for k in range(ppm.ORDER - 1, -1, -1):
        levels[k] = ppm.shorter(*levels[k + 1], k)
    trie = ppm.Trie([levels[k][0] for k in range(ppm.ORDER + 1)], [levels[k][1] for k in range(ppm.ORDER + 1)])
    for ctx in [0, int(cells[3] >> np.uint64(6)), 12345, (1 << 30) - 1]:
        p = 10 ** trie.logs(np.uint64(ctx << 6) + np.arange(64, dtype=np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-9)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_base_scores_equal_brute_force(spark, odd, documents):
    for docs in (documents.where("doc_id < 400"), odd):
        rows = docs.select("doc_id", "text").collect()
        word = re.compile(r"[^\x20\x09-\x0D]+")
        held = [zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2 for r in rows]
        count = collections.Counter()
        for r, h in zip(rows, held):
            if not h:
                count.update(word.findall(lower(r["text"])))
                count["\0"] += 1
        n, v = sum(count.values()), len(count)
        want = []
        for r, h in zip(rows, held):
            toks = word.findall(lower(r["text"])) + ["\0"]
            want.append((repr(r["doc_id"]), h, len(toks), sum(count[w] > 0 for w in toks), n,
                         sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks)))
        got = [(repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
               for r in ppm.score_documents(docs).collect()]
        for g, w in zip(sorted(got), sorted(want)):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0 and math.isfinite(g[6])
        assert len(got) == len(want)
    assert ppm.score_documents(odd.limit(0)).collect() == []


@pytest.mark.parametrize("cells", [2_000_000, 40])
def test_scores_equal_brute_force_whatever_is_broadcast(spark, monkeypatch, cells):
    """The score comes from all counts, also when few cells fit the broadcast table."""
    monkeypatch.setattr(ppm, "MODEL_CELLS", cells)
    docs = [(i, TRAIN[i % len(TRAIN)] + f" row {i % 5}") for i in range(30)] + [(30, ""), (31, None), (32, "quite unseen xyzzy")]
    got = {r["doc_id"]: r for r in ppm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    train = [t or "" for i, t in docs if not got[i]["held_out"]]
    assert len(got) == len(docs) and 0 < len(train) < len(docs)
    symbol, inner = ppm.symbol_map(np.bincount(np.frombuffer("".join(train).encode(), np.uint8), minlength=256))
    for i, text in docs:
        assert got[i]["score"] == pytest.approx(brute_log10(train, (text or "").lower(), symbol, inner, ppm.ORDER), abs=1e-8)


def test_counts_beyond_32_bits():
    values = np.array([3, 7, 9], np.uint64)
    for counts in ([1, 2, 3], [1, 2 ** 32 + 5, 2 ** 40], []):
        u, c = ppm._read_pairs(ppm._pairs(values[:len(counts)], np.array(counts, np.int64)))
        assert u.tolist() == values[:len(counts)].tolist() and c.tolist() == counts
    u, c = ppm._sum([ppm._read_pairs(ppm._pairs(values, np.array([2 ** 32 - 1, 1, 1])))] * 2)
    assert c.tolist() == [2 ** 33 - 2, 2, 2]


def test_long_lanes_are_cut_where_all_states_meet():
    auto = secrets.automaton(secrets.RULES)

    def brute(data):
        state, out = 0, []
        for i, c in enumerate(auto.classes[data].tolist()):
            state = auto.table[state + c]
            if state >= auto.first_accept:
                out.append((i, int(auto.accepts[state // auto.n_classes])))
        return out
    rng = random.Random(1)
    for alphabet in ("abcdefgh  ", "abcdef0123456789", "password: =k ", "AKIAx 0", "aAzZ ghpousr_-x", "tokensecretapikey=: \"'x", " "):
        text = "".join(rng.choices(alphabet, k=6000)) + " password = 'abcdefghijklmnop" + "".join(rng.choices(alphabet, k=3000))
        data = np.frombuffer(text.encode(), np.uint8)
        for lane in (40, 300, 2048):
            at, mask = automaton.scan(auto, data, lane)
            order = np.argsort(at)
            assert list(zip(at[order].tolist(), mask[order].tolist())) == brute(data)


def test_megabytes_without_a_reset_byte():
    import time
    text = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz  ", k=3_000_000)) + " token = abcdefghijklmnopqrst"
    exprs = [re.compile(r.regex, re.IGNORECASE if r.fold else 0) for r in secrets.RULES]
    began = time.process_time()
    found = secrets.find_spans(pa.array([text]), secrets.RULES, secrets.automaton(secrets.RULES), exprs)[0]
    assert time.process_time() - began < 6
    assert [s for s in found if s[2] == 0] == [(3_000_001, len(text), 0)]
