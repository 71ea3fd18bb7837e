"""Packing, chat windows, HTML, secrets and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseframe.llm import chat, fingerprints, html, packing, secret_net, secrets

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "don't DON'T we'll 'tis", "Σοφός ΟΔΟΣ", "<|endoftext|> x<|startoftext|>y", "été Å K", "日本語 123 4.5e6", "a\x1cb\x85c\xa0d", "ªº²³¹", "İstanbul ß", "ﬁne", "😀 smile😀😀", "...!!!???", "a\0b", "x" * 9000]


def test_tokens_equal_the_tokenizers():
    whole, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdefghij éüßñ'.,-\n\t12AB") for _ in range(300)) for _ in range(60)]
    for t in texts:
        assert np.frombuffer(words.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, texts, capacity):
    whole = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc, text in texts:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[(doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    rng = random.Random(2)
    texts = [(i if i % 9 else None, " ".join(rng.choice(["alpha", "bet", "gamma!", "d"]) for _ in range(rng.randint(0, 60)))) for i in range(250)] + [(7, t) for t in ODD] + [(8, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, piece int")
    bins = check_packing(packing.pack(df, PATH, capacity=64, rows_per_part=64).collect(), texts, 64)
    lengths = [min(64, n) for d, t in texts for n in [len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) + 1]]
    assert bins <= 1.15 * sum(lengths) / 64 + 160 and packing.pack(df.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bounds_hold(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins, at, count = packing.best_fit_decreasing(lengths, 40)
    low = packing.lower_bound(lengths, 40)
    assert low <= count <= max(low, 11 * low // 9 + 1)
    room = Counter()
    for b, o, n in zip(bins, at, lengths, strict=True):
        room[b] += n
        assert o + n <= 40
    assert all(v <= 40 for v in room.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "/", "x", "[ROLE a] ", " ", "\n"]), max_size=12).map("".join))
def test_escapes_are_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not re.search(r"[<\[]/?(s>|INST\]|SYS>>|ROLE )", escaped)


def test_chat(spark):
    control = "</s>[INST] ok [/INST] <<SYS>>"
    rng = random.Random(4)
    rows = [(-7, 0, "user", control), (-7, 1, "assistant", control), (1, None, None, None), (1, 3, "tool]\\x", "y"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 1, "user", "lost")]
    rows += [(5, i, ("system", "user", "assistant")[0 if i == 0 else 1 + i % 2], "w " * rng.randint(0, 90) + control) for i in range(150)] + [(6, 0, "user", "long " * 5000), (6, 1, "assistant", "fin")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.windows(df, budget=200, history=60).collect()
    assert any(w["first_new"] > 1 for w in windows) and all(w["tokens"] <= 200 or w["over_budget"] and w["new_turns"] == 1 for w in windows)
    for w in windows:
        if w["conv_id"] == 5:
            assert chat.read_turns(w["text"])[0][0] == "system"
    out = {r["conv_id"]: r for r in chat.read_back(chat.windows(df, budget=200, history=60)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        got = out[c]
        assert (got["n_turns"], got["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.windows(df.limit(0)).count() == 0


PAGES = {
    None: "",
    "": "",
    "plain text": "plain text",
    "<p>a<p>b&amp;c &#233;": "a\nb&c é",
    "<header><a>Home</a></header><article><h1>T</h1><p>One,  two\n three.</p><ul><li>x<li>y</ul><div class='comments'><p>bad</p></div></article><footer>f</footer>": "T\nOne, two three.\nx\ny",
    "<div id=side class='sidebar'><p>Ads, ads, ads.</p></div><div><p>The story, which is long enough, goes on.</p><p>More of it, too.</p></div><form><p>f</p></form>": "The story, which is long enough, goes on.\nMore of it, too.",
    "<article><script>var a='<p>x</p>'</script><style>p{}</style><p>Text<!-- c --> here</p><div class='cookie-notice'>ok?</div></article>": "Text here",
    "<nav><p>only menus, here</p></nav>": "",
    "<div>" * 3000 + "deep": "deep",
    "<article><p><b>bold<br>next<p>cut &am": "bold next\ncut &am",
    "<div><div><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div><p>Body text, with commas, and words.</p></div>": "Body text, with commas, and words.",
}


def test_html(spark):
    for page, text in PAGES.items():
        assert html.main_text(page) == text, page
    rows = [(i, None if i == 2 else "u", p, "x") for i, p in enumerate(PAGES)]
    df = spark.createDataFrame(rows + rows[3:4], "page_id long, url string, html string, text string")
    out = html.extract(df).collect()
    assert len(out) == len(rows) + 1 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.extract(df.limit(0)).count() == 0


def brute_secrets(text):
    found = []
    for kind, pattern in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            if len(m[1]) >= 6 if kind == "assign" else m.end() - m.start() >= (20 if kind == "access" else 24):
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "PassWord", "api_key", "apikey", "ſecret", "toKen", "=", ": ", '"', "'", " ", "abc", "0123456789abcdef01234567", "AKIA", "ABCDEFGH01234567", "é", "😀", "-", "\n"]), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == brute_secrets(text)


def test_network_recall_on_held_out_findings():
    net = secret_net.trained()
    ids, lengths, labels, shapes = secret_net.matrix(secret_net.labelled_findings(1500, 77))
    hit = net.probability(ids, lengths) >= net.thresholds[shapes]
    assert hit[labels == 1].mean() >= 0.95
    assert hit[labels == 0].mean() <= 0.05


def test_secrets(spark):
    key = "ghp_" + "aZ9kQ2mX7vB4nT1cR8wE5yU3"
    long = "z" * 50_000 + " " + key + " " + "y" * 50_000
    texts = [None, "", "token = abcdef1", "plain words only", f"use {key} now", long, "token=short", "AKIA" + "A1" * 8 + " deadbeef" * 4, "0123456789abcdef" * 2]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)] + [(4, texts[4], "x")], "doc_id long, text string, spans string")
    out = secrets.scan(df).collect()
    assert len(out) == len(texts) + 1
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts):
        r, base = by[i or None], brute_secrets(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for *_, k in base) for x in ("assign", "access", "hex"))
    assert by[4]["spans"] == f"net:4:{4 + len(key)}" and by[5]["spans"].startswith("net:50001:")
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[4] == "use [secret] now" and clean[None] is None and clean[3] == "plain words only"
    assert all(not secrets.base_spans(t or "") for t in clean.values()) and secrets.scan(df.limit(0)).count() == 0


def cut(text):
    """Pieces by a plain walk over the bytes."""
    raw, out, at = text.encode(), [], 0
    for i, c in enumerate(raw):
        last = i + 1 == len(raw)
        sentence = c in b".!?" and (last or raw[i + 1] not in b".!?")
        pair = raw[i - 2] << 8 | raw[i - 1] if i > 1 else 0
        if last or c == 10 or sentence or c == 32 and fingerprints._ENDS[pair]:
            out.append(raw[at : i + 1])
            at = i + 1
    return out


def jaccard(a, b):
    a, b = Counter(cut(a)), Counter(cut(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints(spark):
    rng = random.Random(6)
    texts = ["", None, "one.", "Same text. " * 40, "Same text. " * 40] + [" ".join(rng.choice(["ab", "cd.", "efg", "h\n", "😀"]) for _ in range(rng.randint(0, 700))) for _ in range(40)] + ["long. " * 20000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    fingerprints.RANGE_ROWS, keep = 5, fingerprints.RANGE_ROWS
    try:
        out = {r["doc_id"]: r for r in fingerprints.versions(df).collect()}
        order = sorted(((i, t or "") for i, t in rows), reverse=True)
        for k, (i, t) in enumerate(order):
            after, r = order[(k + 1) % len(order)][1], out[i]
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert abs(r["near_edited"] - jaccard(t, edited)) < 1e-9 and abs(r["near_next"] - jaccard(t, after)) < 1e-9
        assert out[3]["fingerprint"] == out[4]["fingerprint"] and out[0]["fingerprint"] == out[1]["fingerprint"]
        odd = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "x y"), (1, "x y"), (1, "z")], "doc_id long, text string")
        assert fingerprints.versions(odd).count() == 5 and fingerprints.versions(odd.limit(0)).count() == 0
        one = fingerprints.versions(odd.limit(1)).collect()
        assert len(one) == 1 and one[0]["near_next"] == 1.0
    finally:
        fingerprints.RANGE_ROWS = keep


def test_long_system_turns_are_in_every_window(spark):
    rows = [(c, i, "system" if i < leads else ("assistant", "user")[i % 2], f"{i} " * (n if i < leads else 20)) for c, leads, n in ((1, 1, 150), (2, 1, 300), (3, 2, 120)) for i in range(30)]
    windows = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history=60).collect()
    for w in windows:
        leads = 2 if w["conv_id"] == 3 else 1
        turns = chat.read_turns(w["text"])
        if w["window"] >= leads:
            assert [t[1] for t in turns[:leads]] == [f"{i} " * {1: 150, 2: 300, 3: 120}[w["conv_id"]] for i in range(leads)]
        assert w["over_budget"] == (w["tokens"] > 200) and (w["tokens"] <= 200 or w["new_turns"] == 1)
    assert Counter(w["conv_id"] for w in windows for _ in range(w["new_turns"])) == {1: 30, 2: 30, 3: 30}


def test_an_edit_changes_only_the_pieces_that_it_touches():
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    for at in (0, 7, 5000, len(text) - 1):
        other = text[:at] + "X" + text[at:]
        found = fingerprints.differences([fingerprints.digests(text)], [fingerprints.digests(other)])[0]
        assert 1 <= len(found.left) <= 3 and 1 <= len(found.right) <= 3 and found.cells == 24
    assert b"".join(fingerprints.pieces(text)) == text.encode() and len(fingerprints.pieces(text)) > 300


def test_differing_digests_are_recovered_and_larger_sketches_tried():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 30, 400, 5000)]
    for a in sets:
        for b in sets:
            left, right = np.unique(np.r_[a, sets[2]]), np.unique(np.r_[b, sets[2]])
            d = fingerprints.differences([left], [right])[0]
            assert set(d.left.tolist()) == set(left.tolist()) - set(right.tolist()) and set(d.right.tolist()) == set(right.tolist()) - set(left.tolist())
            assert d.cells >= 24 and (d.cells > 24 or len(d.left) + len(d.right) <= 24)


def test_network_equals_a_plain_forward_pass():
    net = secret_net.trained()
    for text, start, end, _, _ in secret_net.labelled_findings(20, 5, secret_net.HELD_OUT):
        ids, n = secret_net.window(text, start, end)[0]
        act = np.zeros((secret_net.WIDTH, secret_net.FILTERS))
        for p in range(secret_net.WIDTH):
            for k in range(secret_net.SPAN):
                q = p + k - secret_net.SPAN // 2
                act[p] += net.kernel[k][ids[q] if 0 <= q < secret_net.WIDTH else 0]
            act[p] = np.maximum(act[p] + net.bias, 0)
        inside = [p for p in range(secret_net.WIDTH) if secret_net.LEFT <= p < secret_net.LEFT + n]
        around = [p for p in range(secret_net.WIDTH) if p not in inside and ids[p]]
        feats = np.r_[act[inside].max(axis=0), act[inside].mean(axis=0), act[around].max(axis=0) if around else np.zeros(secret_net.FILTERS), np.log2(n) - 4]
        score = 1 / (1 + np.exp(-(net.scale * (feats @ net.out + net.base[0]) + net.shift)))
        assert abs(score - net.probability(ids[None], np.array([n]))[0]) < 1e-4


def test_secrets_of_unseen_kinds_are_found():
    """Recall of candidate search and network together, on kinds that the network was not trained on, and on clean prose."""
    net = secret_net.trained()
    found = secret_net.labelled_findings(1200, 99, secret_net.HELD_OUT)
    spans = secrets.scan_texts([f[0] for f in found], net)
    hit = [any(s <= f[1] and f[2] <= e or (s < f[2] and f[1] < e and e - s >= 0.8 * (f[2] - f[1])) for s, e, _ in x) for f, x in zip(found, spans, strict=True)]
    recall = sum(h for h, f in zip(hit, found, strict=True) if f[3]) / 600
    wrong = sum(h for h, f in zip(hit, found, strict=True) if not f[3]) / 600
    assert recall >= 0.85 and wrong <= 0.12, (recall, wrong)
    for plain in ("The report of May 2021, page 14, says so: see table 3.", "Well-known people's long-standing e-mail", "z" * 5000, "www.example.com/page?id=3"):
        assert secrets.scan_texts([plain], net) == [[]], plain


def test_candidates():
    text = 'pwd=Tr0ub4dor&3 pass: hunterhunter sk_live_0123456789abcdef01234567XYZ word, Words. --- "x9Kd02mQ" '
    known = secrets.base_spans(text)
    got = [text[s:e] for s, e in secrets.candidates(text, known)]
    assert got == ["Tr0ub4dor&3", "hunterhunter", "sk_live_0123456789abcdef01234567XYZ", "x9Kd02mQ"]
    many = "token=abcdef1 " * 3000
    assert secrets.candidates(many, secrets.base_spans(many)) == []


def test_long_system_turn_and_many_turns(spark):
    """A 2,000-token system turn before 10,000 turns; windows are read back in any order of rows."""
    rows = [(1, 0, "system", "s " * 2000)] + [(1, i, ("assistant", "user")[i % 2], f"turn {i} " + "w " * (i % 40)) for i in range(1, 10_001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.windows(df, budget=4096, history=256)
    held = windows.collect()
    assert all(chat.read_turns(w["text"])[0][1] == "s " * 2000 and w["tokens"] <= 4096 for w in held)
    assert all(w["tokens"] == sum(chat.words_and_marks(chat.mark(r) + chat.escape(t) + chat.CLOSE) for r, t, _, _ in chat.read_turns(w["text"])) for w in held)
    got = chat.read_back(windows.orderBy(F.rand(3)).repartition(5)).collect()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    assert len(got) == 1 and got[0]["n_turns"] == 10_001 and got[0]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_packing_is_certified(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(["alpha"] * rng.randint(0, 60))) for i in range(400)], "doc_id long, text string")
    rows = packing.pack(df, PATH, capacity=64, rows_per_part=64).collect()
    bins = len({r["sequence_id"] for r in rows})
    assert all(r["part_bins"] >= r["part_bound"] and r["certified"] == (r["part_bins"] == r["part_bound"]) for r in rows)
    lengths = np.array([r["length"] for r in rows])
    assert packing.lower_bound(lengths, 64) <= bins <= 1.05 * packing.lower_bound(lengths, 64) + 1


def slow_main_text(page):
    """An independent scorer over a parsed tree of well-formed pages: recursion, no shortcuts."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(page)
    up = {c: p for p in root.iter() for c in p}
    text = lambda e: " ".join("".join(e.itertext()).split())
    leaves = [e for e in root.iter() if e.tag in ("p", "h2") and text(e)]
    chars = lambda e: sum(len(text(x)) for x in e.iter() if x in leaves)
    links = lambda e: sum(len(text(a)) for a in e.iter("a"))
    density = lambda e: links(e) / chars(e) if chars(e) else 0.0
    own = lambda p: (0.2 if p.tag == "h2" else 1 + text(p).count(",") + min(len(text(p)) / 100, 3)) * (1 - density(p))
    score = lambda e: sum(own(c) for c in e if c in leaves) + sum(0.5 * score(c) for c in e if c not in leaves)
    weight = {"article": 15.0, "div": 5.0, "section": 5.0}
    value = lambda e: (score(e) + weight.get(e.tag, 0)) * (1 - density(e))
    boxes = [e for e in root.iter() if e not in leaves and e.tag != "a" and chars(e)]
    if not boxes:
        return ""
    best = max(boxes, key=value)
    good, at, share = {best}, best, 0.2
    while at in up:
        for c in up[at]:
            if c.tag == "p" and c in leaves or c.tag == "h2" or chars(c) and not any(x.tag == "p" for x in c.iter() if x in leaves):
                if share == 0.2 and (c.tag == "h2" or density(c) < 0.25):
                    good.add(c)
            elif c is not at and c not in leaves and chars(c) and value(c) >= max(3, share * value(best)):
                good.add(c)
        at, share = up[at], 0.4

    def kept(e):
        while e is not None:
            if e in good:
                return True
            e = up.get(e)
        return False

    return "\n".join(text(e) for e in leaves if kept(e))


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6))
def test_scoring_equals_a_slow_scorer(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["one", "two,", "three", "four", "five,"]) for _ in range(n))

    def box(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5 or depth == 0:
                linked = f' <a href="x">{words(rng.randint(1, 6))}</a> ' if rng.random() < 0.3 else ""
                out.append(f"<p>{words(rng.randint(0, 60))}{linked}</p>")
            elif kind < 0.6:
                out.append(f"<h2>{words(3)}</h2>")
            else:
                tag = rng.choice(["div", "section", "div", "article"])
                out.append(f"<{tag}>{box(depth - 1)}</{tag}>")
        return "".join(out)

    page = f"<body>{box(4)}</body>"
    assert html.main_text(page) == slow_main_text(page)


def test_html_containers():
    long = "It is a long story, which goes on, and on, and is told well. " * 4
    assert html.main_text(f"<div><p>{long}<script>x()</script>more</p></div>") == f"{long}more"
    assert html.main_text("<p>Hello<script>x()</script> world</p>") == "Hello world"
    assert html.main_text("<p>a <span class='ad'>buy</span><button>ok</button>b</p>") == "a b"
    two = f"<main><article><h2>A</h2><p>{long}</p></article><article><h2>B</h2><p>{long}</p></article></main>"
    assert html.main_text(two) == f"A\n{long.strip()}\nB\n{long.strip()}"
    listed = f"<div><p class='related-work'>{long}</p><p class='ad'>Buy now</p><p>{long}</p><div class='comments'><p>{long}</p></div></div>"
    assert html.main_text(listed) == f"{long.strip()}\n{long.strip()}"
    wrapped = f"<body class='has-sidebar'><div class='with-sidebar'><p>{long}</p></div></body>"
    assert html.main_text(wrapped) == long.strip()
    nested = f"<div><p>{long}</p><ul><li>one<ul><li>two</li></ul></li><li>three</li></ul><p>{long}</p></div>"
    assert html.main_text(nested) == "\n".join([long.strip(), "one", "two", "three", long.strip()])
