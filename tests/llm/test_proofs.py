"""Results of op1 and op7 against rules written out once more, without the modules' kernels."""

import hashlib
import math
import random
import re
import uuid

from parlance.llm import importance, queries, secrets

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1
GOLD = 0x9E3779B97F4A7C15


def _mix(x):
    x &= M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


BYTE = [_mix((b + 1) * GOLD) for b in range(256)]


def _word(word):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in word.encode())
    total, power = 0, 1
    for b in raw:
        total, power = total + BYTE[b] * power, power * GOLD & M
    return _mix(total + len(raw))


def _pair(a, b):
    h = 0
    for x in (a, b):
        h = (h + x) * 0xD6E8FEB86659FD93 & M
        h ^= h >> 32
    return _mix(h)


def _grams(text):
    words = [_word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [h % importance.BUCKETS for h in [*words, *(_pair(a, b) for a, b in zip(words, words[1:]))]]


def _expected(docs, good):
    """log weight and number of n-grams of each row; ``good``: the texts of the target."""
    raw, target = [1.0] * importance.BUCKETS, [0.0] * importance.BUCKETS
    grams = [_grams(t) for _, t in docs]
    for g in grams:
        for b in g:
            raw[b] += 1
    for t in good:
        for b in _grams(t):
            target[b] += 1
    total = sum(raw)
    target = [t + importance.BUCKETS * r / total for t, r in zip(target, raw)]
    whole = sum(target)
    ratio = [math.log(t / whole) - math.log(r / total) for t, r in zip(target, raw)]
    return [(sum(ratio[b] for b in g), len(g)) for g in grams]


def test_weights_of_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [t for i, t in docs if labels.get(i) == 1]
    want = {i: w for (i, _), w in zip(docs, _expected(docs, good))}
    out = queries.queries()["op1_importance_resampling"](spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        weight, n = want[r.doc_id]
        assert r.n_grams == n and abs(r.log_weight - weight) < 1e-6 * max(1, abs(weight))
    k = round(len(good) / len([q for q in labels.values() if q is not None]) * len(docs))
    limit = sorted((r.key for r in out), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= limit) for r in out) and sum(r.kept for r in out) >= k


def test_a_repeated_good_document_counts_once(spark):
    docs = [(1, "good words here"), (1, "good words here"), (1, "other text"), (2, "bad bad"), (3, "more text"), (4, None)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    first = min(["good words here", "other text"], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = _expected(docs, [first])
    out = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), labels, k=2).collect()
    got = sorted((r.n_grams, round(r.log_weight, 9)) for r in out)
    assert got == sorted((n, round(w, 9)) for w, n in want)


KINDS = ["assign", "access", "hex"]


def _base(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=\-]+)""", text, re.I | re.ASCII):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end()))
    for kind, alphabet, lead, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 20), (2, "0123456789abcdef", "", 24)):
        i = 0
        while i < len(text):  # leftmost, as far as it goes
            j = i + len(lead)
            if text.startswith(lead, i):
                while j < len(text) and text[j] in alphabet:
                    j += 1
                if j > i + len(lead):
                    if j - i >= least:
                        spans.append((i, kind, j))
                    i = j
                    continue
            i += 1
    return sorted(spans)


def test_base_spans_of_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    some = 0
    for r in queries.queries()["op7_token_efficiency"](spark, "/root/testdata/sf0.01").collect():
        spans = _base(texts[r.doc_id])
        some += len(spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in spans) for kind in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        listed = [x for x in r.spans.split(",") if x]
        assert [x for x in listed if not x.startswith("random")] == [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
    assert some > 10


def test_recall_and_precision_on_labelled_strings():
    """Random strings of several alphabets against words, digests, identifiers, numbers and paths."""
    import public_tokenizers

    vocabulary = public_tokenizers.path(next(iter(_vocabularies())))
    rng = random.Random(11)
    draw = lambda alphabet, lo, hi: "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "import time file reader model train data batch user name page index value count list order cluster network system report start".split()
    random_ = [draw(b64 + "+/", 24, 44) for _ in range(300)] + [draw(b64 + "_-", 20, 32) for _ in range(200)] + [draw("abcdefghijklmnopqrstuvwxyz0123456789", 24, 40) for _ in range(200)]
    word = lambda: rng.choice(words)
    harmless = [hashlib.md5(str(i).encode()).hexdigest().upper() for i in range(50)] + [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(100)]
    harmless += ["_".join(word() for _ in range(4)) + "_" + str(rng.randint(0, 9999)) for _ in range(150)] + ["-".join(word() for _ in range(5)) for _ in range(150)]
    harmless += ["/".join([word(), word(), word() + "_" + word(), word()]) for _ in range(150)] + ["".join(word().title() for _ in range(5)) for _ in range(150)] + [draw("0123456789", 20, 30) for _ in range(50)]
    found = [s for s in random_ if any(k == 3 for _, k, _ in secrets.spans_of(f"see {s} here", vocabulary))]
    wrong = [s for s in harmless if any(k == 3 for _, k, _ in secrets.spans_of(f"see {s} here", vocabulary))]
    recall, precision = len(found) / len(random_), len(found) / max(1, len(found) + len(wrong))
    print(f"recall {recall:.3f}, precision {precision:.3f} of {len(random_)} random and {len(harmless)} harmless strings")
    assert recall >= 0.95 and precision >= 0.98


def _vocabularies():
    import inspect

    return re.findall(r'path\("([^"]+)"\)', inspect.getsource(secrets))


def _class_of(c):
    o = ord(c)
    if o >= 0x80:
        return "beyond"
    for name, members in (("symbol", "#*$%&|<>"), ("stop", "!,.:;?"), ("quote", "\"'()-"), ("space", " \t"), ("line", "\n\r")):
        if c in members:
            return name
    return "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() else "other"


def _divergence(a, b):
    """Jensen-Shannon distance of two Counters."""
    n, m = sum(a.values()), sum(b.values())
    if not n or not m:
        return 0.0
    total = 0.0
    for k in a.keys() | b.keys():
        p, q = a[k] / n, b[k] / m
        mid = (p + q) / 2
        total += (p * math.log2(p / mid) if p else 0) + (q * math.log2(q / mid) if q else 0)
    return math.sqrt(max(0.0, total / 2))


def test_distances_and_verdicts_of_all_documents(spark):
    from collections import Counter

    docs = {r.doc_id: (re.sub("[-_].*", "", (r.lang or "und").lower()), r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, (_, t) in docs.items()}
    chars = {i: Counter(map(_class_of, t)) for i, (_, t) in docs.items()}
    of_language, char_reference = {}, {}
    for i, (lang, _) in docs.items():
        of_language.setdefault(lang, Counter()).update(words[i])
        char_reference.setdefault(lang, Counter()).update(chars[i])
    common = {lang: {w for w, n in c.items() if n >= 0.002 * sum(c.values())} for lang, c in of_language.items()}
    fold = lambda counts, lang: sum((Counter({w if w in common[lang] else None: n}) for w, n in counts.items()), Counter())
    word_reference = {lang: fold(c, lang) for lang, c in of_language.items()}
    out = queries.queries()["op8_divergence_rules"](spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        lang, text = docs[r.doc_id]
        far_chars, far_words = _divergence(chars[r.doc_id], char_reference[lang]), _divergence(fold(Counter(words[r.doc_id]), lang), word_reference[lang])
        assert abs(r.char_distance - far_chars) < 1e-9 and abs(r.word_distance - far_words) < 1e-9
        n, c = len(words[r.doc_id]), len(text)
        odd = (c >= 200 and far_chars > 0.18 + 2 / math.sqrt(c)) or (n >= 40 and far_words > 0.32 + 1.5 / math.sqrt(n))
        assert r.base_failed == (n < 10 or 100 * r.n_repeat_words > 20 * n) and r.kept == (not r.base_failed and not odd)
    assert 0 < sum(r.kept for r in out) < len(out)
