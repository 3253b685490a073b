"""Secrets under random nestings of encodings, and the forms that one layer can take."""

import base64
import bz2
import gzip
import json
import lzma
import random
import textwrap
import zlib

import pytest

from albumlake.llm.secret_scan import find_secrets

SECRET = "password=hunter2hunter2"
b64 = lambda b: base64.b64encode(b).decode()


def small_window(b, bits=-15):
    c = zlib.compressobj(9, zlib.DEFLATED, bits)
    return c.compress(b) + c.flush()


ONE = {
    "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "hex": lambda t: "".join(f"\\x{b:02x}" for b in t.encode("latin-1")),
    "octal": lambda t: "".join(f"\\{b:03o}" for b in t.encode("latin-1")),
    "entities": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "json": lambda t: json.dumps({"a": t, "b": 'x"y'}),
    "base64": lambda t: b64(t.encode()),
    "wrapped": lambda t: "\n".join(textwrap.wrap(b64(t.encode()), 20)),
    "yaml": lambda t: "key: |\n" + textwrap.indent("\n".join(textwrap.wrap(b64(t.encode()), 24)), "    "),
    "utf16": lambda t: b64(t.encode("utf-16-le")),
    "utf16be": lambda t: b64(t.encode("utf-16-be")),
    "gzip": lambda t: b64(gzip.compress(t.encode())),
    "zlib": lambda t: b64(zlib.compress(t.encode())),
    "window": lambda t: b64(small_window(t.encode(), 9)),
    "deflate": lambda t: b64(small_window(t.encode())),
    "bzip2": lambda t: b64(bz2.compress(t.encode())),
    "xz": lambda t: b64(lzma.compress(t.encode())),
}


def values(text):
    return {v for _, _, _, _, _, v in find_secrets(text)}


@pytest.mark.parametrize("name", sorted(ONE))
def test_each_form(name):
    text = f"see {ONE[name](SECRET + ' and more of it')} here"
    found = [x for x in find_secrets(text) if x[5] == SECRET]
    assert found and 0 <= found[0][1] < found[0][2] <= len(text)


def test_random_nestings():
    r, names = random.Random(11), sorted(ONE)
    for _ in range(400):
        chain = [r.choice(names) for _ in range(r.randrange(1, 5))]
        text = SECRET + " " + "".join(r.choices("abc def\n", k=r.randrange(30)))
        for n in chain:
            text = r.choice(["", "see ", "x: "]) + ONE[n](text) + r.choice(["", " end", "\n"])
        if len(text) < 60_000:
            assert SECRET in values(text), chain


def test_probes():
    assert SECRET in values(f'"{json.dumps(chr(10).join(textwrap.wrap(b64((SECRET + " in a file").encode()), 16)))[1:-1]}"')
    assert "password=hunter2hunter2" in values("pass&#119ord=hunter2hunter2")
    twice = gzip.compress(bz2.compress(lzma.compress((SECRET + " deep").encode())))
    assert SECRET in values(b64(twice))
    long = small_window((("line of text " * 20_000) + SECRET).encode())
    assert SECRET in values(b64(long))


def test_ordinary_text_gives_no_layers_of_noise():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 22))) for _ in range(5000)]
    assert find_secrets(" ".join(words)) == [] and find_secrets("\n  ".join(words)) == []
