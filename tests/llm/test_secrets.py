import base64
import gzip
import hashlib
import re
import time
import urllib.parse
import zlib

from brainweave.llm import secrets

KEY = "AKIA" + "Z" * 16
ASSIGN = "password=hunter2hunter2"


def spans(text):
    base, every = secrets.find_secrets(text)
    return base, every


def test_base_spans():
    text = f'x API_KEY : "abcdEFGH" passwd=short {KEY} ' + "0f" * 16 + " token='a.b-c_d/e+f'"
    base, every = spans(text)
    assert [(k, text[a:b]) for k, a, b in base] == [("assign", 'API_KEY : "abcdEFGH'), ("access", KEY), ("hex", "0f" * 16), ("assign", "token='a.b-c_d/e+f")]
    assert set(base) <= set(every)


def test_base_matches_the_patterns_one_by_one():
    patterns = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    for text in ("secret=secret=abcdefgh12", "pAsSwOrD:  tokenfoo=12345678", "AKIAAKIA" + "1" * 12, "a" * 40 + "G" + "b" * 31, "ſecret=12345678 toKen=abcdefgh", "apikey=" + "é" * 9):
        want = [(k, *m.span()) for k, p, ok in patterns for m in p.finditer(text) if ok(m)]
        assert sorted(secrets.scan(text)) == sorted(want), text


def test_layers_are_unwrapped_and_mapped():
    b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    for wrapped in (b64(ASSIGN), urllib.parse.quote(ASSIGN, safe=""), b64(b64(ASSIGN)), b64(zlib.compress(ASSIGN.encode())), b64(gzip.compress(ASSIGN.encode())), urllib.parse.quote(b64(urllib.parse.quote(f"é {ASSIGN}")), safe=""), "".join(f"\\u{ord(c):04x}" for c in ASSIGN)):
        text = f"é text {wrapped} end"
        base, every = spans(text)
        assert not [s for s in base if s[0] == "assign"] or "%" in wrapped
        found = [s for s in every if s[0] == "assign"]
        assert found and all(text.index(wrapped) <= a < b <= text.index(wrapped) + len(wrapped) for _, a, b in found), wrapped


def test_repeated_pieces_are_found_at_every_place():
    for wrapped in (base64.b64encode(ASSIGN.encode()).decode(), "%70assword%3Dhunter2hunter2", "".join(f"\\u{ord(c):04x}" for c in ASSIGN)):
        text = f"{wrapped} and {wrapped}\n\n{wrapped}"
        assert [(a, b) for k, a, b in spans(text)[1] if k == "assign"] == [m.span() for m in re.finditer(re.escape(wrapped), text)], wrapped
    twice = base64.b64encode(f"a {ASSIGN} b {base64.b64encode(KEY.encode()).decode()}".encode()).decode()
    assert spans(f"{twice} {twice}")[1] == [(k, a, a + len(twice)) for a in (0, len(twice) + 1) for k in ("assign", "access")]


def test_base64_that_is_glued_wrapped_or_not_all_text():
    b64 = lambda s: base64.b64encode(s).decode()
    secret, filler = ASSIGN.encode(), bytes(range(32, 127)) * 3
    packed = b64(zlib.compress(hashlib.sha512(b"x").digest() * 2 + filler + secret))
    plain = b64(b" " * 40 + secret + b" " * 40)
    glued = [f"{before}{b64(what)}" for before in ("/path/", "key_", "id-", "abcde", "Ab1") for what in (secret, zlib.compress(secret), gzip.compress(secret))]
    wrapped = [end.join(whole[i : i + n] for i in range(0, len(whole), n)) for whole in (packed, plain) for n in (64, 76, 61) for end in ("\n", "\r\n")]
    odd = [b64(x) for x in (b"a\0b " + secret, secret + b"\x0c", b"\xff\xfe " + secret, secret + b" \x80")] + [b64(secret + b"!!") + "A"]
    for piece in glued + wrapped + odd:
        text = f"é see {piece} end"
        found = [s for s in spans(text)[1] if s[0] == "assign"]
        assert found and all(6 <= a < b <= 6 + len(piece) for _, a, b in found), piece
    assert [s for s in spans(wrapped[6])[1] if s[0] == "assign"] == [("assign", 0, 64 + 1 + 64)]


def test_base64_that_is_indented_or_split_by_blanks_or_wide():
    b64 = lambda s: base64.b64encode(s).decode()
    whole = b64(b"  " + ASSIGN.encode() + b" and more of it, and more") + "=" * 0
    cut = lambda n, gap: gap.join(whole[i : i + n] for i in range(0, len(whole), n))
    for gap in ("\n  ", "\r\n\t", "  \n", " \n      "):
        piece = cut(20, gap)
        for text in (f"key: |\n  {piece}\nnext: one", f"{piece} {piece}", f"a\n\n{piece}\n\n{piece}\n\n{piece}\n"):
            at = [m.start() for m in re.finditer(re.escape(piece), text)]
            found = [s for s in spans(text)[1] if s[0] == "assign"]
            assert all(any(a <= x < y <= a + len(piece) for _, x, y in found) for a in at), text
    for n in (12, 16, 20, 64):
        text = f"see {cut(n, ' ')} there"
        assert any(k == "assign" and 4 <= a < b <= len(text) for k, a, b in spans(text)[1]), n
    for codec in ("utf-16-le", "utf-16-be", "utf-16"):
        for raw in (ASSIGN.encode(codec), zlib.compress(ASSIGN.encode(codec)), b"\x01" + ASSIGN.encode(codec)):
            text = f"x {b64(raw)} y"
            assert [s for s in spans(text)[1] if s[0] == "assign"] == [("assign", 2, len(text) - 2)], (codec, raw)


def test_short_runs_of_compressed_bytes():
    for inner in (b"a" * 32, b"0" * 64, b"ab" * 20, b"5" * 500):
        raw = zlib.compressobj(9, zlib.DEFLATED, -15)
        piece = base64.b64encode(raw.compress(inner) + raw.flush()).decode()
        for form in (piece, piece.rstrip("="), piece.translate(str.maketrans("+/", "-_"))):
            text = f"see {form} end"
            assert len(piece) <= 12 and spans(text)[1] == [("hex", 4, 4 + len(form))], (inner, form)
    assert spans("myth exam type 2x4y a0b0 gym-x0 system eyes")[1] == []


def test_escapes_keep_what_stands_around_them():
    every = [("password: %68unter2hunter2", 0), ("see password%3D hunter2hunter2 there", 4), ("%70assword : hunter2hunter2", 0), ('"password": "\\u0068unter2hunter2"', 1), ("password = \\x68unter2hunter2", 0), ("%5Cu0070assword%3A hunter2hunter2", 0)]
    for text, a in every:
        assert [s for s in spans(text)[1] if s[0] == "assign"] == [("assign", a, text.index("unter2hunter2") + 13)], text
    text = "token = secret%3Ahunter2hunter2"
    assert spans(text)[1] == [("assign", 8, len(text))]


def test_url_spans_are_exact():
    text = "go?x=%70assword%3Dhunter2hunter2&y=1"
    assert [s for s in spans(text)[1] if s[0] == "assign"] == [("assign", 5, 5 + len("%70assword%3Dhunter2hunter2"))]


def test_all_members_of_a_gzip_stream_are_read():
    parts = [b"first ", b"", b"then pass", b"word=hunter2hunter2", b" last"]
    text = base64.b64encode(b"".join(map(gzip.compress, parts)) + b"rest").decode()
    assert spans(text)[1] == [("assign", 0, len(text))]
    odd = [gzip.compress(x) for x in (b"-" * 50_000, b"-" * 50_001, ASSIGN.encode())]
    text = base64.b64encode(b"".join(odd)).decode()
    assert secrets.find_secrets(text, window=1 << 16)[1] == [("assign", 0, len(text))]


def test_pieces_of_any_size_are_read_in_windows():
    noise = b"".join(hashlib.sha256(b"%d" % i).digest().hex().encode()[:20] + b" - " for i in range(40_000))
    for place in (0, 131_060, 500_000):
        text = base64.b64encode(gzip.compress(noise[:place] + b" " + ASSIGN.encode() + b" " + noise[place:])).decode()
        assert [s for s in secrets.find_secrets(text, window=1 << 17, overlap=1 << 10)[1] if s[0] == "assign"] == [("assign", 0, len(text))], place


def test_three_places_in_a_long_text_without_blanks_in_all_wrappings():
    b64 = lambda s: base64.b64encode(s).decode()
    quote = lambda s: "".join(f"%{x:02x}" for x in s)
    secret = ASSIGN.encode()
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    deflated = raw.compress(secret) + raw.flush()
    every = [b64(secret), b64(b64(secret).encode()), b64(zlib.compress(secret)), b64(gzip.compress(secret)), b64(deflated), quote(secret), quote(zlib.compress(secret)), quote(deflated), "".join(f"%u{x:04x}" for x in secret),
             "".join(f"\\u{{{x:x}}}" for x in secret), "".join(f"\\U{x:08x}" for x in secret), "".join(f"\\x{x:02x}" for x in secret), "".join(f"\\x{x:02x}" for x in zlib.compress(secret)), b64(quote(gzip.compress(secret)).encode()), quote(b64(zlib.compress(zlib.compress(secret))).encode())]
    for piece in every:
        text = f"{piece} {piece}\n{piece}"
        at = [m.start() for m in re.finditer(re.escape(piece), text)]
        found = sorted({s for s in spans(text)[1] if s[0] == "assign"})
        assert all(any(a <= s[1] < s[2] <= a + len(piece) for s in found) for a in at), (piece, found)
    filler = "x.y!" * 170_000
    for piece in every[:3] + every[8:11]:
        text = f"{filler}({piece}){filler}({piece}){filler}({piece})%"
        assert len({s[1] for s in spans(text)[1] if s[0] == "assign"}) == 3 and len(text) > 2_000_000, piece


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000 + "%", "a" * 2_000_000 + "\\u", "%a" * 500_000, "%" * 1_000_000, "x\x9c" * 20_000, "aB3" * 500_000, "Zm9v\n" * 100_000, "Zm9vYmFyZm9vYmFy \t" * 50_000, ("a" * 12 + " " * 1000) * 500, "Kx0a " * 100_000):
        began = time.process_time()
        spans(text)
        assert time.process_time() - began < 20, text[:20]


def test_cycles_bombs_and_prose_end():
    loop = "%2525" * 50
    assert spans(loop) == ([], [])
    bomb = base64.b64encode(zlib.compress(b"0" * (1 << 22))).decode()
    assert secrets.find_secrets(bomb, window=1 << 17)[1] == [("hex", 0, len(bomb))]
    assert spans("Perfectly ordinary prose, with internationalisation and words.") == ([], [])


def test_nulls_long_texts_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 200_000 + ASSIGN, "c"), (4, ASSIGN, "d"), (4, ASSIGN, "d"), (None, KEY, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(secrets.digest_spans(secrets.scan_secrets(df)).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in got] == [
        (None, 0, 1, 0, "access:0:20"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 1, 0, 0, f"assign:1000000:{1_000_000 + len(ASSIGN)}"), (4, 1, 0, 0, "assign:0:23"), (4, 1, 0, 0, "assign:0:23"),
    ]
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4].base_sha256 == hashlib.sha256(b"assign:0:23").hexdigest()
    assert secrets.scan_secrets(df.limit(0)).count() == 0
