import base64
import bz2
import gzip
import hashlib
import html
import lzma
import random
import re
import time
import zlib

import pytest

from lodestone.llm import secrets as S
from lodestone.llm.queries import QUERIES
from tests.llm.cases import awkward, empty

NAMES = r"[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
PLAIN = "password=abcdefgh1"


def _base(text):
    spans = [("assign", *m.span()) for m in re.finditer(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_on_random_text():
    draw = random.Random(2)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", ":", "=", " ", "'", '"', "abcdefgh", "x1", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "É", "ſecret", "toKen", "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert S.ordered(S.find_secrets(text)) == _base(text), text


def test_query_base(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in S.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}


def _b64(data):
    return base64.b64encode(data).decode()


LAYERS = {
    "percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "hex escape": lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    "entities": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "base64": lambda s: _b64(s.encode()),
    "url-safe": lambda s: base64.urlsafe_b64encode(s.encode()).decode(),
    "gzip": lambda s: _b64(gzip.compress(s.encode())),
    "zlib": lambda s: _b64(zlib.compress(s.encode())),
    "bzip2": lambda s: _b64(bz2.compress(s.encode())),
    "xz": lambda s: _b64(lzma.compress(s.encode())),
}


@pytest.mark.parametrize("first", sorted(LAYERS))
@pytest.mark.parametrize("second", [None, *sorted(LAYERS)])
def test_nested_layers(first, second):
    inner = LAYERS[first](PLAIN)
    outer = LAYERS[second](inner) if second else inner
    text = f"É so {outer} on"
    base, every = S.scan(text)
    found = [s for s in every if s not in base and s[0] == "assign"]
    assert found and all(5 <= a < b <= 5 + len(outer) for _, a, b in found)


def test_span_of_a_part():
    inner = f"we say {PLAIN} here"
    text = f"x {_b64(inner.encode())} y"
    ((_, a, b),) = S.scan(text)[1]
    covered = base64.b64decode(text[2:].split()[0])[(a - 2) * 6 // 8 : (b - 2) * 6 // 8 + 1].decode()
    assert PLAIN in covered and len(covered) < len(inner)
    assert S.scan("user=1&password%3Dabcdefgh1&x")[1] == [("assign", 7, 27)]


def test_cycles_and_repeats_end():
    assert S.scan("%2525" * 50)[1] == []
    twice = f"{_b64(PLAIN.encode())} {_b64(PLAIN.encode())}"
    assert len(S.scan(twice)[1]) == 2
    text = PLAIN
    for _ in range(12):
        text = _b64(text.encode())
    ((kind, a, b),) = S.scan(text)[1]
    assert kind == "assign" and a < 40 and b > len(text) - 40


def test_long_tokens_take_linear_time():
    began = time.time()
    for text in ("%" * 400_000, "\\" * 400_000, "&" * 400_000, "a%4" * 200_000, "x" * 400_000 + "%41", "A" * 400_000):
        S.scan(text)
    assert time.time() - began < 20


def test_prose_gives_nothing():
    assert S.scan("thentionanonthere " * 500 + "ABCDEFGHIJKLMNOPQRSTUVWXYZ")[1] == []


def test_awkward_documents(spark):
    rows = S.scan_secrets(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count() and all(r["spans"] == [] for r in rows)
    assert S.scan_secrets(empty(spark)).count() == 0


@pytest.mark.parametrize("depth", [2, 3])
def test_deep_layers_that_repeat_are_found_at_every_place(depth):
    for names in (["base64"] * depth, ["percent", "base64", "unicode"][:depth], ["entities", "gzip", "base64"][:depth]):
        line = PLAIN
        for name in names:
            line = LAYERS[name](line)
        text = "\n".join([f"log {line} end"] * 3)
        starts = [i * (len(line) + 9) for i in range(3)]
        found = [s for s in S.scan(text)[1] if s[0] == "assign"]
        assert all(any(at + 4 <= a < b <= at + 4 + len(line) for _, a, b in found) for at in starts), names


def test_mixed_escapes_end_soon():
    text = "".join(f"%25{'25' * (i % 6)}26amp;amp;amp;\\u0026amp;\\\\u005cu0025" for i in range(6))
    began = time.time()
    S.scan(text)
    assert time.time() - began < 10


@pytest.mark.parametrize("packed", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_all_members_and_what_lies_past_one_window(packed, monkeypatch):
    two = _b64(packed(b"first ") + packed(PLAIN.encode()))
    assert len(S.scan(two)[1]) == 1
    monkeypatch.setattr(S, "UNFOLD", 1 << 12)
    monkeypatch.setattr(S, "OVERLAP", 1 << 8)
    for before in (10, 4090, 4093, 8190, 30_001):
        far = _b64(packed(("é" * before + f" {PLAIN} " + "word " * 3000).encode()))
        assert [k for k, *_ in S.scan(far)[1]] == ["assign"], before


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("width", [12, 50, 64, 76])
def test_base64_over_line_breaks(end, width):
    noise = "".join(random.Random(1).choice("abcdefghijklmnop ") for _ in range(400))
    for data in (("x" * 40 + f" {PLAIN} " + "y" * 90).encode(), gzip.compress(f"{noise} {PLAIN} {noise}".encode()), lzma.compress(PLAIN.encode())):
        for lead, rest in (("", ""), ("key: ", f"{end}then prose goes on")):
            code = _b64(data)
            text = f"{lead}{end if lead else ''}" + end.join(code[i : i + width] for i in range(0, len(code), width)) + rest
            assert any(k == "assign" for k, *_ in S.scan(text)[1]), (len(code), text)


def test_base64_behind_a_prefix_of_its_own_letters():
    for prefix in ("blob_", "example-", "path/to/", "a+b_", "/p/", "v_", "x", "xy", "data", "abcde"):
        code = _b64(f"hello {PLAIN} there".encode())
        ((_, a, b),) = S.scan(f"{prefix}{code}")[1]
        assert len(prefix) < a < b <= len(prefix) + len(code)
        packed = _b64(gzip.compress(PLAIN.encode()))
        assert len(S.scan(f"{prefix}{packed}")[1]) == 1
    began = time.time()
    for text in ("_" * 400_000, "QUFB/" * 80_000, "/QUFB" * 80_000, "abcdefghijklmnopqrst\n" * 20_000, "aGVsbG8gd29y\n" * 20_000):
        S.scan(text)
    assert time.time() - began < 20


def _unwrapped(text, depth=4):
    """Every text inside a text, by plain recursion over whole tokens: what is found, without places."""
    yield text
    if depth:
        for token in text.split():
            inner = [re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(errors="replace"), token)]
            inner.append(re.sub(r"\\u([0-9a-f]{4})|\\x([0-9a-f]{2})", lambda m: chr(int(m[1] or m[2], 16)), token))
            inner.append(html.unescape(token))
            try:
                data = base64.b64decode(token.replace("-", "+").replace("_", "/") + "=" * (-len(token) % 4), validate=True)
            except ValueError:
                data = b""
            for unfold in (bytes, gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress):
                try:
                    inner.append(unfold(data).decode())
                except Exception:  # not of this kind
                    continue
            for x in inner:
                if x and x != token:
                    yield from _unwrapped(x, depth - 1)


def test_random_nesting_against_plain_recursion():
    """As many secrets of each kind as the recursion finds, each within the token that holds it."""
    draw = random.Random(11)
    for _ in range(150):
        text, tokens = "", []
        for n in range(draw.randint(1, 3)):
            token = draw.choice([f"password=hunter{n}{draw.randint(10, 99)}x", f"AKIA{draw.randint(10**12, 10**13)}", "no secret here"])
            for _ in range(draw.randint(0, 3)):
                token = LAYERS[draw.choice(sorted(LAYERS))](draw.choice(["", "see: "]) + token)
            tokens.append((len(text), len(text) + len(token), token))
            text += token + draw.choice([" ", "\n", " and "])
        base, every = S.scan(text)
        for a, b, token in tokens:
            kinds = {k for x in _unwrapped(token) for k, *_ in S.find_secrets(x) if k != "hex"}
            assert kinds <= {k for k, x, y in every if a <= x < y <= b}, token


@pytest.mark.parametrize(
    ("text", "end"),
    [("password%3D hunter2abcdef", 25), ("password = %68unter2abcdef", 26), ("pass%77ord &#61; \\u0068unter2abc", 32), ("%70assword %3D %20hunter2%41bc", 30), ("secret%22: '\\x68unter2abcdef", 28)],
)
def test_layers_reach_over_spaces_and_kinds(text, end):
    assert S.scan(text) == ([], [("assign", 0, end)])


def _decoded_whole(text):
    """One step of all escapes of a whole text, character by character, wherever its spaces are."""
    out, i = "", 0
    while i < len(text):
        for pattern, value in ((r"%([0-9A-Fa-f]{2})", 16), (r"\\x([0-9A-Fa-f]{2})", 16), (r"\\u([0-9A-Fa-f]{4})", 16), (r"&#([0-9]{1,3});", 10)):
            if m := re.compile(pattern).match(text, i):
                out, i = out + chr(int(m[1], value)), m.end()
                break
        else:
            out, i = out + text[i], i + 1
    return out


def test_random_escapes_in_running_text_against_a_decoder_of_whole_texts():
    draw = random.Random(5)
    ways = [lambda c: c, lambda c: c, lambda c: f"%{ord(c):02X}", lambda c: f"\\x{ord(c):02x}", lambda c: f"\\u{ord(c):04x}", lambda c: f"&#{ord(c)};"]
    for _ in range(600):
        text = draw.choice(["so ", "", "x, "]) + draw.choice(["password = hunter2abc", 'TOKEN": "abcdefgh12"', "api_key:  zyxwvuts9", "AKIAABCDEFGHIJKLMN", "no secret = here"]) + draw.choice([" and so on", "", "; x"])
        for _ in range(draw.randint(1, 3)):
            text = "".join(draw.choice(ways)(c) if draw.random() < 0.2 else c for c in text)
        wanted, layer = set(), text
        for _ in range(4):
            wanted |= {k for k, *_ in S.find_secrets(layer) if k != "hex"}
            layer = _decoded_whole(layer)
        assert wanted <= {k for k, *_ in S.scan(text)[1]}, text


@pytest.mark.parametrize("packed", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_compressed_data_behind_every_escape(packed):
    data = packed(f"noise {PLAIN} noise".encode())
    for written in ("".join(f"\\x{b:02x}" for b in data), "".join(f"%{b:02X}" for b in data), "".join(f"\\u{b:04x}" for b in data), "".join(f"&#{b};" for b in data), str(data)[2:-1]):
        spans = [s for s in S.scan(f"É {written} x")[1] if s[0] == "assign"]
        assert spans and all(2 <= a < b <= 2 + len(written) for _, a, b in spans), written


@pytest.mark.parametrize("code", ["utf-16", "utf-16-le", "utf-16-be"])
def test_utf16_in_base64_and_binary_around_text(code):
    text = f"the {PLAIN} is"
    for data in (text.encode(code), gzip.compress(b"\x00" * 600 + text.encode(code) + b"\xff\xfe\x00" * 50), gzip.compress(b"\x00" * 512 + text.encode() + b"\x00" * 512)):
        assert [k for k, *_ in S.scan(f"a {_b64(data)} b")[1]] == ["assign"]


def test_escapes_of_escapes_take_linear_time():
    began = time.time()
    for chain in ("%" + "25" * 500_000 + "41", "\\" + "u005c" * 200_000 + "u0041", "&" + "amp;" * 250_000 + "lt;", "%26amp;%2526amp;" * 5000):
        S.scan(f"password=abcdefg{chain}")
    assert time.time() - began < 20
    assert ("assign", 0, 34) in S.scan("password%25252525253Dhunter2abcdef")[1]
