"""Operators on single texts: quality, secrets, languages, licenses, toxicity; brute force and defined edge cases."""

import base64
import hashlib
import json
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from cohortloom.llm import langid, license_scan, quality, secret_scan, toxicity

EDGES = [None, "", " \t\n", "a", "a a a a a a a a a a a a", "word " * 30000, "\x00\x0b", "é" * 50]


def base_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if n[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_is_exact(spark, docs):
    rng = random.Random(5)
    texts = EDGES + [" ".join(rng.choice("ab cd ef gh # !! | x\ny A.".split(" ")) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = sorted(quality.quality_report(docs(texts)).collect())
    assert len(rows) == len(texts)
    for r in rows:
        c = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])
        assert not (r.base_failed and r.kept)


def test_quality_tells_junk_from_prose(spark, docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    prose = [" ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(60)) for _ in range(120)]
    junk = [" ".join(word() + rng.choice(["&&&", "###"]) for _ in range(60)) for _ in range(15)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(15)]
    kept = {r.doc_id: r.kept for r in quality.quality_report(docs(prose + junk)).collect()}
    assert all(kept[k] for k in range(120)) and not any(kept[k] for k in range(120, 150))
    table = docs(prose + junk)
    out = quality.quality_filter(table)
    assert out.columns == table.columns and out.count() == 120


def test_quality_of_nothing(spark, docs):
    assert quality.quality_report(docs([])).count() == 0
    assert quality.fit({}).shares("1" * len(quality.RULES))[0] > 0


def test_extra_columns_may_clash(spark, docs):
    from pyspark.sql import functions as F

    table = docs(["some words that are good enough to stay, one two three four."] * 3).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x"))
    out = quality.quality_filter(table)
    assert out.columns == table.columns


def brute_secrets(text):
    patterns = [
        (0, r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    return sorted((m.start(), k, m.end()) for k, p, ok in patterns for m in re.finditer(p, text) if ok(m))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "PassWord", "api_key", "apikey", "secret", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGHIJ0123", "0123456789abcdef", "deadbeef", "ſecret", "é", "abcDEF123456", "."]), max_size=14))
def test_base_secrets(parts):
    text = "".join(parts)
    assert secret_scan.base_spans(text) == brute_secrets(text)


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def test_confirmed_secrets():
    rsa = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([65 + k]) * 40) for k in range(8)))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86") + der(5, b"")) + der(4, rsa))
    lp = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + lp(b"none") + lp(b"none") + lp(b"") + (1).to_bytes(4, "big") + lp(b"pub" * 20) + lp(b"priv" * 30)
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1'})}.c2lnbmF0dXJl"
    kinds = lambda t: [secret_scan.KINDS[k] for _, k, _ in secret_scan.confirmed_spans(t)]
    assert kinds(f"x {b64(rsa)} y") == ["key"] and kinds(f"x {b64(pkcs8)} y") == ["key"] and kinds(f"x {rsa.hex()} y") == ["key"]
    assert kinds(f"({b64(ssh)})") == ["ssh"] and kinds(f"bearer {jwt}.") == ["jwt"]
    pem = b64(rsa)
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pem[k : k + 64] for k in range(0, len(pem), 64)) + "\n-----END RSA PRIVATE KEY-----"
    assert kinds(f"a {block} b") == ["key"] and secret_scan.confirmed_spans(f"a {block} b")[0] == (2, 4, 2 + len(block))
    broken = bytearray(rsa)
    broken[5] ^= 1
    assert kinds(b64(bytes(broken))) == [] and kinds("A" * 200) == [] and kinds("eyJhIjoxfQ.eyJhIjoxfQ.x") == []
    assert not secret_scan.is_ssh_key(ssh[:-1]) and secret_scan.items(b"\x30\x80") is None


def test_keys_in_other_wraps():
    """Escaped, quoted, commented and unfenced keys are found; broken inner keys and tiny numbers are refused."""
    rsa = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([65 + k]) * 40) for k in range(8)))
    oid = der(0x30, der(6, b"\x2a\x86\x48\x86") + der(5, b""))
    pkcs8 = lambda inner: der(0x30, der(2, b"\0") + oid + der(4, inner))
    pem = base64.b64encode(rsa).decode()
    lines = [pem[k : k + 64] for k in range(0, len(pem), 64)]
    found = lambda t: [(secret_scan.KINDS[k], t[a:b]) for a, k, b in secret_scan.confirmed_spans(t)]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    for sep in ("\\n", "\\r\\n", "\n> ", "\n# ", '\\n"\n"', "\r\n\t"):
        block = sep.join([begin, *lines, end])
        assert found(f'{{"key": "{block}", "x": 1}}') == [("key", block)], sep
    for sep in ("\n", "\\n", "\n  ", "\n> "):
        assert found("see " + sep.join(lines) + " there") == [("key", sep.join(lines))], sep
    assert found(begin + "\n" + begin + "\n" + "\n".join(lines) + "\n" + end)[0][0] == "key"
    b64 = lambda b: base64.b64encode(b).decode()
    assert found(b64(pkcs8(rsa))) and found(b64(pkcs8(der(4, b"k" * 32)))) and not found(b64(pkcs8(b"garbage" * 6))) and not found(b64(pkcs8(rsa[:-1])))
    tiny = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k])) for k in range(8)))
    assert not secret_scan.is_private_key(tiny) and not secret_scan.is_private_key(der(0x30, der(2, b"\0") * 6))
    assert found(begin + "x" * 200_000 + (begin + "y") * 2000) == []


def test_secret_queries(spark, docs):
    texts = EDGES + ["token = abcdefghijkl0 x", "é token=0123456789abcdef0"]
    rows = {r.doc_id: r for r in secret_scan.secrets(docs(texts)).collect()}
    for k, t in enumerate(texts):
        spans = brute_secrets(t or "")
        names = ",".join(f"{secret_scan.KINDS[x]}:{a}:{b}" for a, x, b in spans)
        assert rows[k].base_sha256 == hashlib.sha256(names.encode()).hexdigest() and rows[k].spans == names
        assert [rows[k].n_assign, rows[k].n_access, rows[k].n_hex] == [sum(s[1] == j for s in spans) for j in range(3)]
    assert [r.text for r in secret_scan.redacted(docs([texts[-1]])).collect()] == ["é [secret]"]
    assert secret_scan.secrets(docs([])).count() == 0


def test_languages(spark, docs):
    rng = random.Random(2)
    stock = {"en": "the of and to in that with this for on".split(), "fr": "le la les des une est pas que dans sur".split()}
    texts = [" ".join(rng.choice(stock["en" if k % 2 else "fr"]) for _ in range(rng.randint(5, 120))) for k in range(300)]
    table = docs(texts + [None, "", "123 !!", "the " * 40000], lang=lambda k: ("en" if k % 2 else "fr") if k < 300 else None)
    rows = {r.doc_id: r for r in langid.language_report(table).collect()}
    assert len(rows) == 304 and all(0 <= r.score <= 1 for r in rows.values())
    held = [k for k in range(300) if rows[k].held_out]
    assert 30 < len(held) < 100 and sum(rows[k].lang_pred == ("en" if k % 2 else "fr") for k in held) >= 0.97 * len(held)
    assert [rows[k].lang_pred for k in range(300, 304)] == ["und", "und", "und", "en"]
    numbers = langid.language_report(docs(texts[:40] + ["½ ² Ⅷ ① ٣", "ª", "\u0301 ⓐ _"], lang=lambda k: "en" if k < 40 else None)).collect()
    assert [r.lang_pred for r in sorted(numbers, key=lambda r: r.doc_id)[40:]] == ["und", "en", "und"]
    assert {r.lang_pred for r in langid.language_report(docs(["abc"], lang=lambda k: None)).collect()} == {"und"}
    assert langid.language_report(docs([])).count() == 0


def test_folded_tables_equal_the_network():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (20, langid.WINDOW + 3)).astype(np.uint8)
    net = langid.fit(x, ["a", "b"] * 10, epochs=1)
    e = net.embed[x]
    pooled = [(sum(e[:, j : j + langid.WINDOW] @ c[j] for j in range(w)) + b).max(axis=1) for w, c, b in zip(langid.WIDTHS, net.conv, net.bias, strict=True)]
    s = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out + net.out_bias
    s = np.exp(s - s.max(axis=1, keepdims=True))
    assert np.allclose(langid.Reader(net).windows(x), s / s.sum(axis=1, keepdims=True), atol=1e-4)


def test_gradient():
    """A step of the fit goes where differences of the loss point."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(97, 110, (64, langid.WINDOW + 3)).astype(np.uint8)
    x[::2, ::5] = 120
    y = ["a", "b"] * 32

    def loss(net):
        e = net.embed[x].astype(float)
        pooled = [(sum(e[:, j : j + langid.WINDOW] @ c[j] for j in range(w)) + b).max(axis=1) for w, c, b in zip(langid.WIDTHS, net.conv, net.bias, strict=True)]
        s = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out + net.out_bias
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(64), np.searchsorted(["a", "b"], y)] - np.log(np.exp(s).sum(axis=1))).mean())

    # One batch is all rows: Adam's first step moves each parameter by the rate against the sign of its gradient.
    start, moved = langid.fit(x, y, epochs=0, batch=64), langid.fit(x, y, epochs=1, batch=64, rate=1e-4)
    for name, k in (("out", None), ("out_bias", None), ("embed", None), ("conv", 0), ("conv", 2), ("bias", 1)):
        part = lambda net: getattr(net, name) if k is None else getattr(net, name)[k]  # noqa: B023, E731
        p, step = part(start), part(moved) - part(start)
        agree = seen = 0
        for at in rng.permutation(p.size)[:60]:
            i = np.unravel_index(at, p.shape)
            was = p[i]
            p[i] = was + 1e-3
            up = loss(start)
            p[i] = was - 1e-3
            slope = (up - loss(start)) / 2e-3
            p[i] = was
            if abs(slope) > 1e-5 and step[i]:
                seen += 1
                agree += (slope > 0) == (step[i] < 0)
        assert seen and agree >= 0.95 * seen, name


def longest_increasing(pairs):
    best = []
    for k, (_, j) in enumerate(pairs):
        best.append(1 + max((best[x] for x in range(k) if pairs[x][1] < j), default=0))
    return max(best, default=0)


@settings(max_examples=150, deadline=None)
@given(st.permutations(range(9)))
def test_longest_increasing(p):
    pairs = list(enumerate(p))
    out = license_scan.increasing(pairs)
    assert len(out) == longest_increasing(pairs) and all(a[1] < b[1] and a[0] < b[0] for a, b in zip(out, out[1:], strict=False))


def test_licenses(spark, docs):
    mit, apache = license_scan.TEMPLATES["MIT text"], license_scan.TEMPLATES["Apache-2.0 header"]
    damaged = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    texts = ["Some prose.\nReleased under the MIT License.", f"x y {damaged} z", f"{apache}\n{mit}", "the license of permission to use under", None, "", "word " * 20000 + "All rights reserved."] + ["Licensed under CC BY-NC 4.0. " * 3]
    rows = license_scan.licenses(docs(texts)).collect()
    found = {k: sorted(r.license for r in rows if r.doc_id == k) for k in range(len(texts))}
    assert found == {0: ["MIT"], 1: ["MIT text"], 2: ["Apache-2.0 header", "MIT text"], 3: [], 4: [], 5: [], 6: ["Proprietary"], 7: ["CC-BY-NC-4.0"] * 3}
    r = next(r for r in rows if r.doc_id == 0)
    assert texts[0][r.start : r.end] == "Released under the MIT License" and r.coverage == 1.0
    assert next(r for r in rows if r.doc_id == 1).coverage == pytest.approx(11 / 12, abs=0.02)


def test_what_surrounds_a_license_makes_no_difference():
    rng = random.Random(4)
    scan = license_scan.Scanner()
    for name in ("MIT text", "Apache-2.0 header", "BSD text", "GPL-3.0"):
        template = license_scan.TEMPLATES[name].split()
        for _ in range(6):
            body = [w for w in template if rng.random() > 0.06]
            if rng.random() < 0.5:
                body = [x for k, w in enumerate(body) for x in ([w, "zzz"] if k % 4 == 3 else [w])]
            alone = [(f[0], f[2]) for f in scan(" ".join(body)) if f[0] == name]
            pad = lambda: [w for _ in range(60) for w in rng.sample(["license", "copy", "of", "the", "use", "software", "river", "to", "permission"], 6)]
            padded = [(f[0], f[2]) for f in scan(" ".join([*pad(), *body, *pad()])) if f[0] == name]
            assert len(alone) == len(padded) == (len(alone) and 1) and all(p[1] >= a[1] - 2 for a, p in zip(alone, padded, strict=True))
    twice = " ".join([license_scan.TEMPLATES["MIT text"]] * 2)
    assert [f[0] for f in scan(twice)] == ["MIT text"] * 2
    shifted = "İİİ " + license_scan.TEMPLATES["MIT"]
    assert [shifted[f[3] : f[4]] for f in scan(shifted)] == [license_scan.TEMPLATES["MIT"]]


def brute_cover(words, template):
    """The longest common subsequence within any window that a cover may fill."""
    best, size = 0, len(template) + len(template) // 2 + 2
    for a in range(max(1, len(words) - size + 1)):
        row = [0] * (len(template) + 1)
        for w in words[a : a + size]:
            prev = 0
            for j, x in enumerate(template, 1):
                prev, row[j] = row[j], max(row[j], row[j - 1], prev + (w == x))
        best = max(best, row[-1])
    return best / len(template)


def test_license_scan_against_brute_force():
    """With words that occur once the alignment is the longest common subsequence."""
    rng = random.Random(7)
    template = [f"w{k}" for k in range(30)]
    scan = license_scan.Scanner({"T": " ".join(template)})
    seen = Counter()
    for _ in range(200):
        body = [w for w in template if rng.random() > rng.choice([0.02, 0.15, 0.2, 0.3])]
        for _ in range(rng.randrange(14)):
            body.insert(rng.randrange(len(body) + 1), "x")
        words = ["a"] * rng.randrange(80) + body + ["b"] * rng.randrange(80)
        brute = brute_cover(words, template)
        found = scan(" ".join(words))
        assert bool(found) == (brute >= 0.8 - 1e-9)
        assert not found or abs(found[0][1] - brute) < 1e-9
        seen[bool(found)] += 1
    assert min(seen.values()) > 30


def test_long_runs_take_linear_time():
    import time

    from cohortloom.llm.secret_scan import base_spans, confirmed_spans

    for unit in ("7", "a", "aF", "A", "0f", "ey.", "ey", "-", "-----BEGIN ", "token ", "AKIA", "/+", "=", "secret="):
        text = unit * (100_001 // len(unit)) + "1" * 81 + "g"
        began = time.perf_counter()
        base_spans(text)
        confirmed_spans(text)
        assert time.perf_counter() - began < 3, unit


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=1, max_size=9))
def test_automaton_equals_edit_distance(token):
    terms = {"abcd": 1.0, "abcabc": 1.0, "dcbadcba": 1.0, "abcdabcda": 1.0}
    found = toxicity.Automaton(toxicity.Lexicon(terms)).match(token)
    near = {t: edit_distance(t, token) for t in terms}
    good = {t: d for t, d in near.items() if d <= toxicity.edits(t) and (d == 0 or t[0] == token[0] or (d == 1 and len(t) >= toxicity.FREE))}
    best = min(good.values(), default=None)
    if found:
        assert found[2] == near[found[0]] == best
    else:
        assert best is None or min(near[t] - 0 for t in terms if near[t] <= toxicity.edits(t)) < best


def test_quotation_and_abuse():
    """Pairs of marks and words about words make a quotation; apostrophes and reported speech don't."""
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {})
    scorer = toxicity.Scorer(lexicon)
    quoted = lambda t: [q for *_, q in scorer.hits(t)]
    abuse = [
        "you're an idiot, don't talk to me", "c'est un idiot, n'est-ce pas", "t'es qu'un idiot, j'te dis", "you are an idiot", "he said you are a idiot", "the dogs' idiot owner didn't come",
        "\"hello\" you idiot \"bye\"", "it’s an idiot’s idea", "what a 'fine' idiot 'you' are", "l'idiot", "she calls and says idiot", "idiot", "\" idiot \"", "rock 'n' roll idiot",
    ]
    spoken = [
        "the word «idiot» means a fool", "he wrote \"you idiot\" there", "'idiot' is what he wrote", "“what an idiot”", "„du idiot“ stand da", "‘idiot’", "the term idiot is old", "`idiot'", "»idiot«", "\"don't be an idiot, can't you\" was written",
    ]
    assert [t for t in abuse if quoted(t) != [False]] == [] and [t for t in spoken if quoted(t) != [True]] == []


def test_toxicity(spark, docs):
    rng = random.Random(3)
    prose = lambda: [rng.choice(["river", "stone", "walk", "bright", "over", "under", "house", "tree", "seven", "music"]) for _ in range(30)]
    texts, y = [], []
    for k in range(400):
        w = prose()
        if k % 4 == 0:
            w.insert(rng.randrange(30), rng.choice(["scoundrel", "blockhead", "nitwitty"]))
        texts.append(" ".join(w))
        y.append(int(k % 4 == 0))
    extra = ["you are a scoundrle now", "you scoundrell", None, "", "the word «scoundrel» means a rogue", "you bl0ckhead", "zcoundrel", "you blockhe@d, go", "42 1999"]
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(y)], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_report(docs(texts + extra), labels).collect()}
    held = [k for k in range(400) if rows[k].held_out]
    assert 60 < len(held) < 140 and all(rows[k].predicted == y[k] for k in held)
    assert all(rows[k].predicted == 1 for k in (400, 405, 406, 407)) and rows[408].predicted == 0
    assert rows[401].predicted == 1 and rows[402].predicted == rows[403].predicted == 0
    assert rows[404].score < rows[401].score and rows[404].quoted == 1 and all(0 <= r.score <= 1 for r in rows.values())
    none = toxicity.toxicity_report(docs(["a"]), labels.limit(0)).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.0, 0)]
