import base64
import bz2
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import quote

from tallymark.llm import decode_scan
from tallymark.llm.decode_scan import Found, _masked, find_secrets, redact, scan, secrets
from tallymark.llm.queries import QUERIES


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)


def test_base_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = base_spans(r.text or "")
        n = [sum(k == x for _, x, _ in spans) for k in range(3)]
        want[r.doc_id] = (*n, hashlib.sha256(listed(spans).encode()).hexdigest())
    rows = QUERIES["op8_decode_scan"](spark, sf).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == want and len(rows) == len(want)
    assert any(r.spans for r in rows)


def test_layers_map_to_the_original():
    key = "AKIA" + "Q" * 16
    nested = base64.b64encode(quote(f"é token={'z' * 9}", safe="").encode()).decode()
    packed = base64.b64encode(gzip.compress(f"x {key} y".encode())).decode()
    points = "".join(f"\\u{ord(c):04x}" for c in key)
    for text, kind, part in ((f"ä {nested} end", 0, None), (f"say {packed} end", 1, packed), (f"b {points} c", 1, points),
                             (f"q {quote(key, safe='').replace('A', '%41')} r", 1, quote(key).replace("A", "%41"))):
        spans = scan(text).spans
        hit = [(s, e) for s, k, e in spans if k == kind]
        assert hit, text
        if part:
            assert text[hit[0][0]:hit[0][1]] == part
        else:
            assert nested.startswith(text[hit[0][0]:hit[0][1]][:1]) or text[hit[0][0]:hit[0][1]] in nested


def test_base_spans_stay_and_repeats_end():
    text = "password=%70assword=abcdef token = 'deadbeefdeadbeefdeadbeefdeadbeef' " + "QUFB" * 50
    assert set(base_spans(text)) <= set(scan(text).spans)
    assert scan("").spans == [] and scan("%zz \\u12 ====").spans == []


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "passwd: abcdef", "c"),
                                (3, "w " * 300_000 + "token=abcdefgh", "d")], "doc_id bigint, text string, spans string")
    got = sorted((str(r.doc_id), len(r.base)) for r in find_secrets(df).collect())
    assert got == [("1", 0), ("2", 0), ("2", 0), ("3", 1), ("None", 1)]
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert out[None] == "[SECRET]" and out[1] is None and out[3].endswith("w [SECRET]")
    assert redact(df).columns == df.columns and find_secrets(df.limit(0)).collect() == []


SECRET = "password=hunter2hunter2"
PLAIN = base64.b64encode(SECRET.encode()).decode()


def masked(text, part, kind=0):
    """Whether a find of the kind lies in the part."""
    at = text.index(part)
    return any(k == kind and at <= s < e <= at + len(part) for s, k, e in scan(text).spans)


def test_base64_after_a_path_or_a_name():
    packed = base64.b64encode(gzip.compress(f"x {SECRET} y".encode(), mtime=0)).decode()
    for part in (PLAIN, PLAIN.rstrip("="), packed):
        for before in ("", "blob:", "https://x.example.com/a/", "blob_", "id-", "a/", "ab/", "abc/", "some-longer_name/"):
            for after in ("", "/", " end", "_more"):
                text = f"see {before}{part}{after}"
                assert scan(text).spans, text
                assert part is packed or masked(text, part + after), text


def test_base64_over_line_breaks():
    long = "ä " * 40 + SECRET + " and more of it" * 9
    for raw in (long.encode(), gzip.compress(long.encode(), mtime=0), long.encode("latin-1")):
        whole = base64.b64encode(raw).decode()
        for width, line_break in ((64, "\n"), (76, "\r\n"), (20, "\n  ")):
            part = line_break.join(whole[i:i + width] for i in range(0, len(whole), width))
            for text in (f"-----BEGIN X-----\n{part}\n-----END X-----", f"data: {part}", f"data:\n\n{part}\n\nand on"):
                assert masked(text, part), (width, text)
    lines = "\n".join(base64.b64encode(x.encode()).decode() for x in ("some name is here", SECRET, "passwd: abcdefgh"))
    assert len({s for s, _, _ in scan(lines).spans}) >= 2


def test_bytes_that_are_no_utf8():
    for raw in (b"\xff" + SECRET.encode() + b"\xfe", SECRET.encode() + b"\xe4 caf\xe9"):
        part = base64.b64encode(raw).decode()
        assert masked(f"x {part} y", part)
        escaped = "".join(f"%{c:02X}" for c in raw)
        assert masked(f"x {escaped} y", escaped)
        packed = base64.b64encode(gzip.compress(raw, mtime=0)).decode()
        assert masked(f"x {packed} y", packed)


def test_no_layer_is_too_large():
    for box, fill in ((bz2.compress, "aaaaaaaaa\n"), (gzip.compress, "a, b.\n"), (zlib.compress, "\0"), (bz2.compress, "a b\n")):
        for text in (SECRET + "\n" + fill * 200_000, fill * 900_000 + SECRET, fill * 300_000 + PLAIN + "\n" + fill * 9):
            part = base64.b64encode(box(text.encode())).decode()
            assert masked(f"x {part} y", part), (box, fill, len(part))
            assert SECRET not in _masked(f"x {part} y", "-") and part not in _masked(f"x {part} y", "-")
    parts = base64.b64encode(gzip.compress(b"pass") + gzip.compress(SECRET[4:].encode())).decode()
    assert masked(f"x {parts} y", parts)


def test_pieces_cut_nothing():
    rng = random.Random(3)
    words = ["a,", "b.\n", "cc", "\n\n", "(d)", SECRET, f"url/{PLAIN}", "token  =  'abcdef'"]
    text = " ".join(rng.choice(words) for _ in range(30_000))
    kept, found = decode_scan.PIECE, Found()
    try:
        decode_scan.PIECE = 5_000
        pieces = list(decode_scan._pieces(gzip.compress(text.encode()), found))
    finally:
        decode_scan.PIECE = kept
    assert "".join(pieces) == text and len(pieces) > 20 and found.skipped == 0
    assert sum(len(secrets(x)) for x in pieces) == len(secrets(text))


def test_compressed_within_compressed():
    secret = b"x password=hunter2abc y"
    for packed in (gzip.compress(gzip.compress(secret)), bz2.compress(b"ab" + zlib.compress(secret)),
                   zlib.compress(bz2.compress(gzip.compress(secret)) + b"tail")):
        text = "see " + base64.b64encode(packed).decode() + " end"
        assert any(kind == 0 for _, kind, _ in scan(text).spans)


def test_content_before_an_error_is_read():
    packed = bytearray(gzip.compress(b"x password=hunter2abc y" * 3))
    packed[-8] ^= 1   # the checksum
    assert any(kind == 0 for _, kind, _ in scan(base64.b64encode(bytes(packed)).decode()).spans)


def test_long_content_without_a_place_to_cut_is_one_piece():
    kept = decode_scan.PIECE
    try:
        decode_scan.PIECE = 1_000
        text, found = "a1" * 50_000, Found()   # a run that four times PIECE would have parted
        assert list(decode_scan._pieces(gzip.compress(text.encode()), found)) == [text] and found.skipped == 0
        words = "some words of prose " * 2_000
        pieces = list(decode_scan._pieces(gzip.compress(words.encode()), found))
        assert "".join(pieces) == words and max(map(len, pieces)) < 3_000
    finally:
        decode_scan.PIECE = kept
