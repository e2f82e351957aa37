import base64
import bz2
import gzip
import lzma
import random
import time
import urllib.parse
import zlib

from tidewater.llm import secret_scan
from tidewater.llm.secret_scan import find_secrets


def spans(text):
    return secret_scan._joined(find_secrets(text)[1])


def test_base_rules():
    assert spans('x token = "deadbeef01"') == "assign:2:21"
    assert spans("secret:token:abcdefg") == ""  # the failing match takes the second keyword with it
    assert spans("paſsword=abcdefgh") == ""  # only ASCII letters in either case
    assert spans("API_KEY='Zm9v.bar'") == "assign:0:17"
    assert spans("AKIA" + "A" * 16 + " AKIA" + "B" * 15) == "access:0:20"
    assert spans("g" + "0a" * 12 + " " + "f" * 23) == "hex:1:25"


def test_layers_and_their_spans():
    secret = "password: hunter2hunter2"
    once = base64.b64encode(secret.encode()).decode()
    assert spans(f"see {once} end") == f"assign:4:{4 + len(once)}"
    packed = base64.b64encode(gzip.compress(base64.b64encode(gzip.compress(secret.encode())))).decode()
    assert spans(f"q {packed}") == f"assign:2:{2 + len(packed)}"
    quoted = urllib.parse.quote(packed, safe="")
    assert spans(f"ä {quoted} z") == f"assign:2:{2 + len(quoted.rstrip('D').rstrip('3').rstrip('%')) if not packed.endswith('=') else 2 + len(quoted)}"
    escaped = 'password \\u003d "ab\\u0063def\\u0067" z'
    base, found = find_secrets(escaped)
    assert base == [] and found == [(0, 0, escaped.index('" z'))]
    assert spans("x token%3Dabcdef%2Bgh y") == "assign:2:21"


def test_fixpoints_end():
    text = "%25" * 50 + "25" * 20
    assert find_secrets(text)[0] == [(148, 2, 190)]
    assert find_secrets(text)[1][0][0] <= 148
    assert find_secrets("&amp;" * 100 + "amp;" * 100) == ([], [])


def test_nulls_empties_repeats(frame):
    docs = frame((1, None), (None, ""), (2, "token=abcdef"), (2, "token=abcdef"), extra="spans")
    got = sorted((r.doc_id or 0, r.n_assign, r.spans) for r in secret_scan.scan_documents(docs).collect())
    assert got == [(0, 0, ""), (1, 0, ""), (2, 1, "assign:0:12"), (2, 1, "assign:0:12")]
    assert secret_scan.scan_documents(docs.limit(0)).count() == 0


def test_unfolding_is_bounded(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_UNFOLDED", 1000)
    bomb = base64.b64encode(gzip.compress(b"token=abcdefgh " * 1000)).decode()
    assert spans(bomb) == ""


def test_every_copy_of_an_encoded_secret_is_found():
    once = base64.b64encode(b"password: hunter2hunter2").decode()
    twice = base64.b64encode(f"see {once}".encode()).decode()
    text = f"{once} {twice} {once}"
    inner = 4 * 4 // 3  # "see " ahead of the run inside the second
    at = [0, len(once) + 1 + inner, len(once) + len(twice) + 2]
    assert spans(text) == ",".join(f"assign:{a}:{a + n}" for a, n in zip(at, (len(once), len(twice) - inner, len(once))))
    # a copy behind another path, whose inner layer was seen before
    quoted = urllib.parse.quote(once, safe="").replace("c", "%63")
    assert spans(f"{once} {quoted}") == f"assign:0:{len(once)},assign:{len(once) + 1}:{len(once) + 1 + len(quoted)}"


def test_payloads_with_unprintable_characters():
    for mark in "\u00a0\ufeff\u200b\u00ad\u3000\f\x1b\0":
        once = base64.b64encode(f"{mark}caf\u00e9 password: hunter2hunter2".encode()).decode()
        ahead = len(f"{mark}caf\u00e9 ".encode()) * 4 // 3
        assert spans(f"see {once}") == f"assign:{4 + ahead}:{4 + len(once.rstrip('='))}", repr(mark)
    for coded, ahead in (("latin-1", 4), ("utf-16", 10)):
        once = base64.b64encode("\u00e9t\u00e9 password: hunter2hunter2".encode(coded)).decode()
        assert spans(once) == f"assign:{ahead * 4 // 3}:{len(once.rstrip('='))}", coded
    # a text that begins like compressed data
    once = base64.b64encode(b"x^2 password: hunter2hunter2").decode()
    assert spans(once) == f"assign:5:{len(once.rstrip('='))}"


def test_base64_over_several_lines():
    noise = random.Random(3).randbytes(300).hex(" ", 3)
    for data, ahead in ((gzip.compress(f"{noise} password: hunter2hunter2".encode()), 0), (b"-" * 39 + b" password: hunter2hunter2", 40)):
        for gap in ("\n", "\r\n", "\n  "):
            whole = base64.b64encode(data).decode()
            block = gap.join(whole[i : i + 64] for i in range(0, len(whole), 64))
            first = ahead * 4 // 3
            end = len(block.rstrip("=")) if ahead else len(block)
            assert spans(f"key: {block}\nand more") == f"assign:{5 + first}:{5 + end}", gap


def test_compressed_data_behind_escapes():
    for data in (pack(b"password: hunter2hunter2 " + b"some words, some more words " * 9 + bytes(range(0, 256, 17))) for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress)):
        forms = [urllib.parse.quote(data, safe=""), urllib.parse.quote_plus(data), "".join(f"%{b:02x}" for b in data), repr(data)[2:-1], "".join(f"\\x{b:02x}" for b in data)]
        for shown in forms:
            assert spans(f"see {shown} end") == f"assign:4:{4 + len(shown)}", shown


def test_each_secret_of_a_run_has_its_own_part():
    parts = [b"password: hunter2hunter2", b"token=abcdefgh12", b"secret=zyxwvu99"]
    once = base64.b64encode(b"\n".join(parts)).decode()
    starts = [0, len(parts[0]) + 1, len(parts[0]) + len(parts[1]) + 2]
    want = [(2 + a * 4 // 3, 2 - (-(a + len(p)) * 4 // 3)) for a, p in zip(starts, parts)]
    assert spans(f"x {once}") == ",".join(f"assign:{a}:{b}" for a, b in want)


def test_all_members_of_compressed_data():
    data = b"".join(gzip.compress(x) for x in (b"nothing here", b"and password: hunter2hunter2", b"key AKIA" + b"Q" * 16))
    once = base64.b64encode(data).decode()
    assert spans(once) == f"assign:0:{len(once)},access:0:{len(once)}"
    cut = base64.b64encode(gzip.compress(b"password: hunter2hunter2") + gzip.compress(b"more")[:-9] + b"\0" * 9).decode()
    assert spans(cut) == f"assign:0:{len(cut)}"


def test_deep_escapes_cost_time_in_proportion():
    deep = "%" + "25" * 500_000
    began = time.process_time()
    find_secrets(deep)
    assert time.process_time() - began < 20
    nested = "token%" + "25" * 40 + "3Dabcdefgh"
    assert (0, 0, len(nested)) in find_secrets(nested)[1]
    layer = secret_scan.unescape_wholly(secret_scan.Layer("a&amp;amp;lt;b%5Cx2541\\u0025zz &;"))
    assert layer.text == "a<bA%zz &;" and layer.origin(1, 2) == (1, 13)
    assert secret_scan.unescape_wholly(secret_scan.Layer("100% & plain; 25")) is None


def test_random_texts_by_brute_force():
    """Every secret put somewhere under random wrappings is found inside the part that holds it, and base findings follow the rules."""
    draw = random.Random(7)
    wraps = [lambda s: urllib.parse.quote(s, safe=""), lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s)]
    for _ in range(60):
        inner = f"say password: {draw.randbytes(6).hex()}z ok"
        for _ in range(draw.randint(1, 4)):
            inner = draw.choice(wraps)(inner)
        text = f"word {draw.randint(0, 9)} {inner} tail"
        base, found = find_secrets(text)
        start = text.index(inner)
        assert any(kind == 0 and start <= a and b <= start + len(inner) for a, kind, b in found), text
        assert set(base) <= set(found) and all(0 <= a < b <= len(text) for a, _, b in found)
