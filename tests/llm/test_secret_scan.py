from __future__ import annotations

import base64
import gzip
import os
import random
import re
import subprocess
import sys
import time
import urllib.parse
import zlib

import pytest

from revdiff.llm import queries, secret_scan

from .conftest import EDGE, SCHEMA, table

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SECRET = "password=hunter2hunter2"
KEY = "AKIA" + "ABCDEFGH12345678"


def b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


LAYERS = {
    "url": urllib.parse.quote(SECRET, safe="").replace("hunter", "%68unter"),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "html": "".join(f"&#{ord(c)};" for c in SECRET),
    "base64": b64(SECRET.encode()),
    "zlib": b64(zlib.compress(SECRET.encode())),
    "gzip": b64(gzip.compress(SECRET.encode())),
    "twice": b64(b64(SECRET.encode()).encode()),
    "url of base64": "".join(f"%{c:02x}" for c in b64(SECRET.encode()).encode()),
    "zlib of base64": b64(zlib.compress(b64(SECRET.encode()).encode())),
    "base64 of url": b64(urllib.parse.quote(SECRET, safe="").encode()),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_are_found_where_they_are(name):
    text = f"é日 before {LAYERS[name]} after"
    base, more = secret_scan.find_all(text)
    assert not base and more
    a, kind, b = more[0]
    assert kind == 0 and text[a:b] in LAYERS[name]
    if name not in ("url",):
        assert text[a:b].rstrip("=") == LAYERS[name].rstrip("=")
    assert secret_scan.masked(text, "#").count("#") == 1


def test_self_reference_ends():
    deep = SECRET
    for _ in range(12):
        deep = urllib.parse.quote(deep, safe="").replace("A", "%41")
    assert secret_scan.find_all(deep)[1]
    assert secret_scan.find_all("%25" * 500) == ([], [])


@pytest.mark.parametrize("other", LAYERS)
@pytest.mark.parametrize("name", ["base64", "gzip", "twice"])
def test_each_copy_of_an_encoded_secret_has_its_span(name, other):
    text = f"one {LAYERS[name]} two\nthree {LAYERS[other]} four\nfive {LAYERS[name]} six"
    more = secret_scan.find_all(text)[1]
    for part in {LAYERS[name], LAYERS[other]}:
        for m in re.finditer(re.escape(part), text):
            assert any(m.start() <= a and b <= m.end() for a, _, b in more)
    assert secret_scan.masked(text, "#").count("#") == 3


def test_each_copy_is_redacted(spark):
    copy = LAYERS["base64"]
    got = secret_scan.redact_secrets(table(spark, [f"{copy} a\n{copy} b {LAYERS['gzip']}"])).collect()
    assert got[0].text == "[SECRET] a\n[SECRET] b [SECRET]"


def hidden(name):
    """One encoded secret, as (text before, encoded, text after)."""
    r = random.Random(3)
    noise = "".join(r.choices("bcdeghij klmnopqrs", k=900))
    deep = f"{noise} {SECRET} {noise}".encode()
    wrap = lambda x, n, sep="\n": sep.join(x[i : i + n] for i in range(0, len(x), n))
    member = gzip.compress(noise.encode(), mtime=0)
    tail = bytearray(gzip.compress(deep, mtime=0))
    tail[-6] ^= 0xFF
    flushed = zlib.compressobj()
    flushed = flushed.compress(deep) + flushed.flush(zlib.Z_FULL_FLUSH)
    return {
        "french": ("a ", b64(("é à ç è ù ê ô î û â " * 20 + SECRET + " très élevé où ça").encode()), " z"),
        "gzip in zlib": ("a ", b64(zlib.compress(gzip.compress(deep))), " z"),
        "zlib as %xx": ("a ", "".join(f"%{c:02X}" for c in zlib.compress(deep)), " z"),
        "gzip as quoted url": ("a=", urllib.parse.quote(gzip.compress(deep, mtime=0), safe=""), "&z"),
        "gzip as escapes": ("日本 ", "".join(f"\\x{c:02x}" for c in gzip.compress(deep, mtime=0)), " z"),
        "second member": ("a ", b64(member + gzip.compress(deep, mtime=0)), " z"),
        "over two members": ("a ", b64(gzip.compress(b"x " + SECRET[:12].encode()) + gzip.compress(SECRET[12:].encode())), " z"),
        "wrong sum": ("a ", b64(bytes(tail)), " z"),
        "broken tail": ("a ", b64(flushed + b"\xff" * 500), " z"),
        "cut off": ("a ", b64(gzip.compress(noise.encode()) + flushed), " z"),
        "wrapped": ("a:\n", wrap(b64(gzip.compress(deep, mtime=0)), 76), "\n"),
        "wrapped by windows, indented": ("a:\r\n  ", wrap(b64(gzip.compress(deep, mtime=0)), 64, "\r\n  "), "\r\nz"),
        "wrapped after words": ("a long following\nword\n", wrap(b64(zlib.compress(deep)), 76), "\nnext words"),
        "wrapped in short lines": ("a\n", wrap(b64(SECRET.encode()), 12), "\n"),
        "wrapped twice": ("a ", b64(wrap(b64(gzip.compress(deep, mtime=0)), 76).encode()), " z"),
    }[name]


HIDDEN = "french|gzip in zlib|zlib as %xx|gzip as quoted url|gzip as escapes|second member|over two members|wrong sum|broken tail|cut off|wrapped|wrapped by windows, indented|wrapped after words|wrapped in short lines|wrapped twice".split("|")


@pytest.mark.parametrize("name", HIDDEN)
def test_no_layer_is_left_out(name):
    before, secret, after = hidden(name)
    base, more = secret_scan.find_all(before + secret + after)
    assert not base and any(kind == 0 and len(before) <= a < b <= len(before + secret) for a, kind, b in more)
    assert min(a for a, _, _ in more) >= len(before) and max(b for _, _, b in more) <= len(before + secret)


def test_text_without_secrets_has_none():
    r = random.Random(5)
    for k in range(200):
        assert secret_scan.find_all(b64(r.randbytes(300 + k)) + "\n" + "\n".join(r.choices(["one", "Hk text", "x^2", "longerwordsthansixteen"], k=9)))[1] == []


def plain(text):
    """The three rules of the base, written out."""
    out = []
    word = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_equals_the_rules():
    r = random.Random(1)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "ſecret", "=", ":", " ", "'", '"', "abcdefgh", "ab", KEY, "AKIA", "0123456789abcdef" * 2, "f", "é", "\n", "token:secret:abcdefghij"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 9)))
        assert secret_scan.find_all(text)[0] == plain(text)


def test_operator_and_query(spark, edge, tmp_path):
    texts = [f"x {SECRET} {KEY}", LAYERS["base64"], "clean", None]
    docs = table(spark, texts)
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs).collect()}
    assert [(s.kind, s.start, s.base) for s in got[0]] == [("assign", 2, True), ("access", 26, True)] and not got[2] and not got[3]
    assert [s.base for s in got[1]] == [False]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op9_secrets(spark, str(tmp_path)).collect()}
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (1, 1, 0) and rows[0].spans == "assign:2:25,access:26:46"
    assert rows[1].n_assign == 0 and rows[1].spans.startswith("assign:0:") and rows[2].spans == ""
    assert secret_scan.find_secrets(edge).count() == len(EDGE)
    assert secret_scan.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_redaction(spark):
    docs = table(spark, [f"x {SECRET} y", "clean", None])
    got = {r.doc_id: r for r in secret_scan.redact_secrets(docs).collect()}
    assert got[0].text == "x [SECRET] y" and got[0].n_chars == 12 and got[1].text == "clean" and got[2].text is None
    assert set(got[0].asDict()) == set(docs.columns)


def test_nested_codes_take_time_in_proportion():
    began = time.process_time()
    assert secret_scan.find_all("%" + "25" * 500_000)[1] == []
    chain = "%5c" + "x255c" * 150_000 + "x70"
    assert secret_scan.find_all(f"a {chain}assword=hunter2hunter2 b")[1] == [(2, 0, 2 + len(chain) + 22)]
    assert time.process_time() - began < 20


BOMB = """
import base64, resource, sys, zlib
from revdiff.llm import secret_scan
z, parts = zlib.compressobj(9, zlib.DEFLATED, 31), []
for k in range(100):
    parts.append(z.compress(bytes(1_000_000)))
    if k == 60:
        parts.append(z.compress(b" password=hunter2hunter2 "))
text = "a " + base64.b64encode(b"".join(parts) + z.flush()).decode() + " b"
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = secret_scan.find_all(text)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, len(text), found)
"""


def test_unpacked_data_are_never_held_whole():
    said = subprocess.run([sys.executable, "-c", BOMB], capture_output=True, text=True, check=True, cwd=REPO).stdout.split("\n")[0]
    grown, size, found = said.split(" ", 2)
    assert int(grown) < 200 * 1024 and eval(found) == ([], [(2, 0, int(size) - 2)])


def test_secrets_at_the_edges_of_windows(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 500)
    monkeypatch.setattr(secret_scan, "OVERLAP", 60)
    for pad in range(380, 520, 7):
        text = b64(gzip.compress(b"~" * pad + SECRET.encode() + b"~" * 900))
        assert [k for _, k, _ in secret_scan.find_all(f"a {text} b")[1]] == [0]


@pytest.mark.parametrize("before", ["\\n", "x", "ab", "abc", '\\"', "key\\t", "\\/", "a\\\\n"])
def test_base64_glued_to_what_stands_before_it(before):
    text = f"é {before}{LAYERS['base64']} z"
    more = secret_scan.find_all(text)[1]
    assert len(more) == 1 and text[more[0][0] : more[0][2]].endswith(LAYERS["base64"])


def test_json_inside_json():
    text = r'{"body": "{\"password\": \"hunter2hunter2\"}"} and {\\\"token\\\": \\\"abcdefghij\\\"}'
    found = [text[a:b] for a, k, b in secret_scan.find_all(text)[1]]
    assert any("hunter2hunter2" in x for x in found) and any("abcdefghij" in x for x in found)


def long_run(size, seed):
    r = random.Random(seed)
    return ("".join(r.choices("0123456789", k=1000)) * (size // 1000 + 1))[:size]


@pytest.mark.parametrize("size", [300_000, 900_000, 1_500_000, 3_000_000])
@pytest.mark.parametrize("filler", ["", "~", "~~"])
def test_a_run_longer_than_a_part_keeps_its_secret(size, filler):
    inner = filler + b64((long_run(size * 3 // 4, 1) + " " + SECRET + " x").encode())
    assert secret_scan.find_all(f"a {b64(gzip.compress(inner.encode(), mtime=0))} b")[1]


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 2000)
    monkeypatch.setattr(secret_scan, "OVERLAP", 300)
    monkeypatch.setattr(secret_scan, "PIECE", 256)


@pytest.mark.parametrize("at", range(0, 12_000, 1234))
@pytest.mark.parametrize("kind", ["base64", "base64 twice", "gzip in base64", "gzip later", "gzip in gzip", "zlib in base64 of zlib"])
def test_every_part_of_long_data_is_read(small_parts, kind, at):
    """A secret anywhere in data of six parts, in one layer more or two, wherever these begin."""
    r = random.Random(at)
    noise = lambda n: "".join(r.choices("bcdfghjkl mnpqrstvwxz", k=n))
    deep = (noise(at) + " " + SECRET + " " + noise(12_000 - at)).encode()
    head = noise(r.randint(0, 5000)).encode() + b" ~" + b"~" * r.randint(0, 3)
    inner = {
        "base64": lambda: head + b64(deep).encode(),
        "base64 twice": lambda: head + b64(b"." + b64(deep).encode()).encode(),
        "gzip in base64": lambda: head + b64(gzip.compress(r.randbytes(9000) + deep, mtime=0)).encode(),
        "gzip later": lambda: head + b64(r.randbytes(5000) + gzip.compress(r.randbytes(9000) + deep, mtime=0)).encode() + b" end",
        "gzip in gzip": lambda: head + gzip.compress(r.randbytes(9000) + deep, mtime=0) + b" end",
        "zlib in base64 of zlib": lambda: head + b64(zlib.compress(head + b64(zlib.compress(r.randbytes(7000) + deep)).encode())).encode(),
    }[kind]()
    text = b64(gzip.compress(inner, mtime=0))
    more = secret_scan.find_all(f"a {text} b")[1]
    assert (2, 0, 2 + len(text)) in more or any(k == 0 and a == 2 for a, k, b in more)


def test_noise_has_no_secrets_in_any_part(small_parts):
    r = random.Random(6)
    for k in range(20):
        assert secret_scan.find_all(b64(gzip.compress(r.randbytes(20_000) + b64(r.randbytes(9000)).encode())))[1] == []
