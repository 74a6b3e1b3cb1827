"""Secret scans: the plain patterns, and secrets under layers of encoding."""

import base64
import bz2
import gzip
import lzma
import re
import urllib.parse
import zlib

import pytest

from tablegauge.llm.secrets import redact_secrets, redacted, scan_secrets, secret_spans
from tests.llm.helpers import documents, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SECRET = "password = hunter2-hunter2"


def plain(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_plain_patterns(spark):
    docs = [*texts(20), (500, 'API_KEY: "abcdef" ſecret=abcdefg token=abc token:abcdef.'), (501, "AKIA" + "A1" * 8 + " AKIA" + "B" * 15),
            (502, "🙂 " + "deadbeef" * 3 + " 0123456789abcdef0123456 "), (503, "secret=token:abcdef123 passwd = 'x' password=" + "y" * 50_000)]
    got = scan_secrets(documents(spark, docs)).collect()
    expected = {(i, tuple(plain(t or ""))) for i, t in docs}
    assert {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.depth == 0)) for r in got} == expected
    assert len(got) == len(docs)


def coverings(kind):
    data = SECRET.encode()
    b64 = lambda b: base64.b64encode(b).decode()
    return {
        "url": urllib.parse.quote(SECRET, safe=""), "url twice": urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET), "references": "".join(f"&#{ord(c)};" for c in SECRET),
        "base64": b64(data), "urlsafe": base64.urlsafe_b64encode(b"??>>" + data).decode(), "base64 twice": b64(b64(data).encode()),
        "gzip": b64(gzip.compress(data)), "zlib": b64(zlib.compress(data)), "bz2": b64(bz2.compress(data)), "xz": b64(lzma.compress(data)),
        "gzip of gzip": b64(gzip.compress(gzip.compress(data))), "url of base64 of gzip": urllib.parse.quote(b64(gzip.compress(data)), safe=""),
        "base64 of unicode": b64("".join(f"\\u{ord(c):04x}" for c in SECRET).encode()),
    }[kind]


@pytest.mark.parametrize("kind", ["url", "url twice", "unicode", "references", "base64", "urlsafe", "base64 twice", "gzip", "zlib", "bz2", "xz",
                                  "gzip of gzip", "url of base64 of gzip", "base64 of unicode"])
def test_layers(kind):
    hidden = coverings(kind)
    text = f"some words é🙂 before {hidden} and after"
    spans = [s for s in secret_spans(text)[0] if s[0] == "assign"]
    begin, end = text.index(hidden), text.index(hidden) + len(hidden)
    assert spans and all(begin <= a < b <= end for _, a, b, _ in spans)
    assert any(b - a >= 0.8 * len(hidden) for _, a, b, _ in spans)
    assert hidden not in redacted(text, "[{kind}]")


def test_places_within_a_layer():
    text = "é x%3Dtoken%3Dabcdef%3B y"
    assert ("assign", text.index("token"), text.index("%3B"), 1) in secret_spans(text)[0]


def test_cycles_bombs_and_garbage():
    assert secret_spans("%25" * 50 + "41")[0] == []
    bomb = base64.b64encode(zlib.compress(b"a" * 1_000_000)).decode()
    assert secret_spans(bomb, limit=10_000)[2] == 1 and secret_spans(bomb)[2] == 0
    for text in ("%", "%zz", "\\u12", "\\ud800 \\U00110000 &#xFFFFFF;", "=" * 40, "H4sIAAAAAAAA" * 3, "%ff%fe", "eJ" + "A" * 30):
        secret_spans(text)


def test_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark, [(1, "x token=abcdef1 y"), (2, None), (3, ""), (3, ""), (None, "deadbeef" * 4)])
    out = redact_secrets(docs)
    assert out.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "x [assign] y"), (2, None), (3, ""), (3, ""), (None, "[hex]")], key=str)
    assert scan_secrets(documents(spark, [])).collect() == []
