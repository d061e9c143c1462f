"""Secrets, BPE, personal data: brute force, the library itself, exact spans."""

import random
import re
import time
from hashlib import sha256

import pytest

from strandgraph.llm import bpe, pii, secret_scan

ODD = [(1, None, "x"), (2, "", "x"), (3, "plain words", None), (3, "plain words", None), (None, "token = abcdef12", "y"), (5, "é" * 50_000 + " AKIA" + "A" * 16, "z")]
SCHEMA = "doc_id long, text string, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- secrets -----------------------------------------------------------------------


def plain_secrets(text):
    out = []
    for kind, pattern in (
        (0, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        (1, r"AKIA[A-Z0-9]+"),
        (2, r"[0-9a-f]+"),
    ):
        for m in re.finditer(pattern, text):
            if (len(m[2]) >= 6) if kind == 0 else (len(m[0]) >= (20 if kind == 1 else 24)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_secret_base_spans_against_plain_patterns():
    r = random.Random(1)
    pool = ["token", "secret", "Api_Key", "PASSWORD", "=", ":", " ", '"', "'", "AKIA", "A" * 16, "a1b2" * 6, "xyz.=", "abc", "é", "\n", "0f" * 11, "token=token: "]
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 25)))
        assert sorted(secret_scan.base_spans(text)) == plain_secrets(text)


def test_token_efficiency():
    enc = secret_scan.encoding(secret_scan.vocabulary_path())
    found = lambda t: [t[a:b] for a, k, b in secret_scan.random_spans(t, enc, 2.4)]
    assert found("key kJ8sQz2LmX9pRt4VwB7n end") == ["kJ8sQz2LmX9pRt4VwB7n"]
    for clean in ("md5: d41d8cd98f00b204e9800998ecf8427e", "commit DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", 'ETag: "d41d8cd98f00b204e9800998ecf8427e"', "550e8400-e29b-41d4-a716-446655440000", "some_long_identifier_name_42", "internationalization", "20240131235959123", "getUserAccountSettingsPage"):
        assert found(f"see {clean} here") == []
    # Nothing calls these digests.
    assert found("token = d41d8cd98f00b204e9800998ecf8427e") == found("see d41d8cd98f00b204e9800998ecf8427e") == ["d41d8cd98f00b204e9800998ecf8427e"]


PROSE = "the people of this town read old letters about winter rain and count every small boat while der Hafen schläft und la ville dort bien tarde en la noche".split()


def planted(r, secrets):
    """A prose text, and the code point spans of what was planted in it."""
    text, spans = "", []
    for secret in secrets:
        text += " ".join(r.choice(PROSE) for _ in range(r.randint(3, 12))) + r.choice([" ", ": ", " (", "\n"])
        spans.append((len(text), len(text) + len(secret)))
        text += secret + r.choice([" ", ") ", "\n", ", "])
    return text + " ".join(r.choice(PROSE) for _ in range(5)), spans


def test_recall_of_planted_random_strings():
    r = random.Random(31)
    enc = secret_scan.encoding(secret_scan.vocabulary_path())
    letters = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "hex": "0123456789ABCDEF", "url": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"}
    hit, every, wrong = 0, 0, 0
    for _ in range(400):
        secrets = ["".join(r.choice(letters[kind]) for _ in range(r.randint(20, 64))) for kind in r.choices(sorted(letters), k=3)]
        text, spans = planted(r, secrets)
        found = {(a, b) for a, _, b in secret_scan.random_spans(text, enc, 2.4)}
        # A run of the url alphabet may begin or end with a separator; what counts is the run.
        hit += len(found & set(spans))
        every += len(spans)
        wrong += len(found - set(spans))
    assert hit / every >= 0.95 and wrong / every <= 0.02, (hit / every, wrong / every)


def test_dotted_parts_urls_and_random_letters():
    enc = secret_scan.encoding(secret_scan.vocabulary_path())
    found = lambda t: [t[a:b] for a, k, b in secret_scan.random_spans(t, enc, 2.4)]
    jwt = ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4ifQ", "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJVadQssw5c"]
    assert found("jwt " + ".".join(jwt)) == jwt
    assert found("SG.kJ8sQz2LmX9pRt4VwB7n1A.Zq3xW8vT5nK2mB7yL4cR9dF6hJ1pS0gA") == ["kJ8sQz2LmX9pRt4VwB7n1A", "Zq3xW8vT5nK2mB7yL4cR9dF6hJ1pS0gA"]
    assert found("at the end.kJ8sQz2LmX9pRt4VwB7n") == ["kJ8sQz2LmX9pRt4VwB7n"]
    for token in ("qzjxkvwpbnmfhgtdrlcyqzjxkvwp", "XQZJKWVPLMNBTRFGHDXQ", "qzxj-8391-kvwp-2047"):
        assert found(f"key {token} end") == [token]
    assert found("https://hooks.example.com/services/kJ8sQz2LmX9pRt4VwB7n?x=1") == ["kJ8sQz2LmX9pRt4VwB7n"]
    for clean in ("https://a1b2c3d4e5f6g7h8.x9y8z7w6v5u4t3s2r1q0.net/index/page", "https://example.com/2024/01/31/title-of-the-long-article", "2024-01-31_23-59-59", "Wait.Internationalization", "ADMINISTRATION_RESPONSIBILITIES"):
        assert found(f"see {clean} here") == []


def test_secret_rows(odd, none):
    rows = secret_scan.scan_secrets(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["base_sha256"] == sha256(b"").hexdigest() and by[1]["spans"] == ""
    assert by[None]["n_assign"] == 1 and by[5]["spans"] == "access:50001:50021"
    assert secret_scan.scan_secrets(none).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token=abcdef9 b", "en", "s", 17), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in secret_scan.redact_secrets(docs).collect()}
    assert rows[1]["text"] == "a [SECRET] b" and rows[1]["n_chars"] == 12 and rows[2]["text"] is None
    assert secret_scan.redact_secrets(docs).columns == docs.columns


# -- BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def check(library, text):
    coder = bpe.encoder(bpe.vocabulary_path())
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library(library):
    r = random.Random(2)
    words = ["the", "Straße", "naïve", "l'été", "it's", "we'll", "x1y2", "日本語", "🙂🙂", "a" * 90, "Σίσυφος ΟΔΟΣ", "İ", "e\u0301", "<|endoftext|>", "<|startoftext|>", "\x1c", "\u2028", "...", "''s", "42", "½", "\t\n"]
    for _ in range(400):
        check(library, "".join(r.choice(words) + r.choice(["", " ", "  "]) for _ in range(r.randint(0, 12))))
    for text in ("", " ", "ab" * 20_000, "".join(chr(r.randint(33, 0x4FF)) for _ in range(3000))):
        check(library, text)


def test_forced_boundaries_never_change_the_result():
    coder = bpe.encoder(bpe.vocabulary_path())
    for word in ("zqxjkvbpyw", "internationalisation", "qqqqxxzz", "🙂ab🙂"):
        symbols = "".join(coder.alphabet[b] for b in word.encode())
        assert coder.word_ids(word) == list(coder.merge(symbols, True))
        assert "".join(coder.cut(symbols)) == symbols


def test_chunks_are_encoded_like_their_words():
    coder, r = bpe.encoder(bpe.vocabulary_path()), random.Random(5)
    pool = ["the", "é", "it's", "''s", "x1", "42", "½", "...", "(", "日本", "🙂", "\U00010400", "\U0001d7d8", "\x1c", "\x1f", " ", "\u2003", "\n"]
    for _ in range(2000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 15)))
        words = coder.words.findall(coder.normalize(text))
        assert "".join(words) == re.sub(f"[{bpe.SPACE}]", "", coder.normalize(text))
        assert coder.encode(text) == [i for w in words for i in coder.word_ids(w)]
        assert b" ".join([p[1] for p in coder.pieces(text)]).decode() == coder.decode(coder.encode(text))


def test_code_points_are_not_compared_with_every_range():
    coder, text = bpe.encoder(bpe.vocabulary_path()), "né à côté, " * 20_000

    def cost(run):
        took = []
        for _ in range(3):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    plain = cost(lambda: re.findall(r"[^\W\d_]+|[^\w\s]+", text))
    assert cost(lambda: coder.normalize(text)) < 3 * plain
    assert cost(lambda: coder.words.findall(text)) < 6 * plain


def test_bpe_rows(spark, odd, none):
    rows = bpe.encode_digests(odd).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert bpe.encode_digests(none).count() == 0
    ids = bpe.encode_texts(odd)
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_ids(ids).collect()}
    assert texts[3] == "plain</w> words</w>" and texts[1] == ""


# -- personal data ------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_spans_against_plain_patterns():
    r = random.Random(3)
    pool = ["a", "b.c", "@", "@@", ".", "x.org", "-", " ", "+", "1", "23", "4111111111111111", "255", "256", "(555)", "192.168.0.1", "%", "é", "\n", "4111 1111 1111 1111"]
    for _ in range(4000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 22)))
        assert sorted(pii.base_spans(text)) == plain_pii(text), text


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("write to jane dot doe (at) mail [dot] example dot org today", "email", "jane dot doe (at) mail [dot] example dot org"),
        ("write jane[at]example.org now", "email", "jane[at]example.org"),
        ("pay four one one one one one one one one one one one one one one one soon", "card", "four one one one one one one one one one one one one one one one"),
        ("jоhn@example.com", "email", "jоhn@example.com"),
        ("call ＋４４ ２０ ７９４６ ０９５８", "phone", None),
        ("host １９２.168.0.１", "ip", "１９２.168.0.１"),
        ("from 192[.]168[.]0[.]7 on", "ip", "192[.]168[.]0[.]7"),
        ("from one nine two dot one six eight dot zero dot seven on", "ip", "one nine two dot one six eight dot zero dot seven"),
        ("ring plus four four two zero seven nine four six zero nine on", "phone", "plus four four two zero seven nine four six zero nine"),
        ("mail jane_at_mail_dot_org now", "email", "jane_at_mail_dot_org"),
        ("a\u200bb@c.de", "email", "a\u200bb@c.de"),
    ],
)
def test_deobfuscation_maps_back(text, kind, hidden):
    base, every = pii.spans_of(text)
    added = [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base]
    if hidden is None:
        assert set(base) <= set(every)
    else:
        assert (kind, hidden) in added and set(base) <= set(every)


@pytest.mark.parametrize("text", ["look at the dot on the map", "we met at noon at home", "one of two or three", "un an et deux mois à la fois", "Ünïcödé wörds", "a look-at-me.com page", "at one point in time", "version 1.2 dot 3"])
def test_clean_texts_stay_clean(text):
    assert pii.spans_of(text) == ([], [])


def test_pii_rows(odd, none):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" for r in rows)
    assert pii.find_pii(none).count() == 0


@pytest.mark.parametrize(
    "hidden",
    ["jane at my-host dot com", "jane at mail dot it", "jane at mail dot at", "jane arroba correo punto se", "jane  at\nmail  dot\torg", "jane-at-my-host-dot-org", " dot ".join(["segment"] * 12) + " at mail dot org", "jane_dot_doe_at_mail_dot_org"],
)
def test_wide_disguises(hidden):
    text = f"write: {hidden}, now"
    assert [(text[a:b], k) for a, k, b in pii.spans_of(text)[1]] == [(hidden, 0)]


@pytest.mark.parametrize("text", ["look at this point in time", "he looked at the dot on the map", "at some point we met", "at that point it rained"])
def test_prose_is_no_address(text):
    assert pii.spans_of(text) == ([], [])


def test_bpe_equals_the_library_for_every_code_point():
    library = bpe.library(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    ours = bpe.encoder(bpe.vocabulary_path())
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 14):
        texts = [f"a{c}a 1{c}\u0323!{c}\u0334!" for c in points[at : at + (1 << 14)]]
        assert [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if ours.encode(t) != e.ids] == []
    r = random.Random(2)
    texts = ["".join(r.choice([chr(r.randint(32, 126)), chr(r.randint(0xA0, 0x24F)), chr(r.randint(0x300, 0x36F)), r.choice(points)]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    assert [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if ours.encode(t) != e.ids] == []


def disguise(r):
    """A disguised identifier and its kind."""
    name, host, top = r.choice(["jane.doe", "info", "m_ruiz", "k-lind99"]), r.choice(["mail", "my-host", "uni"]), r.choice(["com", "org", "de", "fr", "es"])
    alike = str.maketrans("aeopcx", "аеорсх")
    words = {"en": "zero one two three four five six seven eight nine".split(), "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(), "fr": "zéro un deux trois quatre cinq six sept huit neuf".split(), "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split()}
    kind = r.choice(["email", "phone", "ip"])
    if kind == "email":
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" {at} ", "."), (" arroba ", " punto "), (" arobase ", " point ")])
        plain = r.random() < 0.3
        return (f"{name}@{host}.{top}".translate(alike) if plain else f"{name}{at}{host}{dot}{top}"), 0
    if kind == "phone":
        w = words[r.choice(sorted(words))]
        return "plus " + " ".join(w[int(c)] for c in "".join(r.choice("123456789") for _ in range(r.randint(9, 12)))), 3
    return r.choice([" dot ", "[.]", " (dot) ", "(.)"]).join(str(r.randint(1, 255)) for _ in range(4)), 1


def test_recall_of_planted_disguises():
    r = random.Random(32)
    hit = every = wrong = 0
    for _ in range(500):
        hidden = [disguise(r) for _ in range(2)]
        text, spans = planted(r, [h for h, _ in hidden])
        want = {(a, k, b) for (a, b), (_, k) in zip(spans, hidden, strict=True)}
        base, found = pii.spans_of(text)
        added = set(found) - set(base)
        hit += len(want & set(found))
        every += len(want)
        wrong += len(added - want)
    assert hit / every >= 0.9 and wrong / every <= 0.05, (hit / every, wrong / every)


def test_deobfuscation_is_linear():
    import time

    line, took = "тел +7 495 123 45 67 аbс\n", []
    for n in (2000, 16_000):
        start = time.perf_counter()
        assert len(pii.spans_of(line * n)[1]) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0]
