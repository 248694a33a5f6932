import base64
import hashlib
import json
import random
import re

import pytest

from tripleloom.llm.secret_scan import (
    KINDS, is_der_key, is_openssh_key, is_signed_token, op5_secrets, redact_secrets, scan_secrets, scanner,
)


def size(n):
    return bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")


def tlv(tag, value):
    return bytes([tag]) + size(len(value)) + value


RNG = random.Random(5)
big = lambda n: b"\x01" + RNG.randbytes(n - 1)
RSA = tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, big(n)) for n in (128, 3, 128, 64, 64, 64, 64, 64)))
ALGORITHM = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")) + tlv(5, b""))
PKCS8 = tlv(0x30, tlv(2, b"\0") + ALGORITHM + tlv(4, RSA))
PUBLIC = tlv(0x30, ALGORITHM + tlv(3, b"\0" + RSA))
EC = tlv(0x30, tlv(2, b"\1") + tlv(4, big(32)) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))))
text_field = lambda b: len(b).to_bytes(4, "big") + b
OPENSSH = b"openssh-key-v1\0" + text_field(b"none") + text_field(b"none") + text_field(b"") + (1).to_bytes(4, "big") + text_field(big(51)) + text_field(big(136))
b64 = lambda b: base64.b64encode(b).decode()
url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
JWT = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '12'})}.c2lnbmF0dXJl"


@pytest.mark.parametrize("key", [RSA, PKCS8, PUBLIC, EC])
def test_keys_parse_and_damaged_ones_do_not(key):
    assert is_der_key(key)
    assert not is_der_key(key[:-1]) and not is_der_key(key + b"\0") and not is_der_key(b"\x31" + key[1:])


def test_containers_and_tokens():
    assert is_openssh_key(OPENSSH) and not is_openssh_key(OPENSSH[:-1]) and not is_openssh_key(OPENSSH + b"x")
    h, p, _ = JWT.split(".")
    assert is_signed_token(h, p) and not is_signed_token(url({"typ": "JWT"}), p) and not is_signed_token(h, url([1]))


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        (f"é {JWT}, x", "jwt", JWT),
        (f"k {b64(RSA)} x", "der", b64(RSA)),
        (f"k {PKCS8.hex().upper()} x", "der", PKCS8.hex().upper()),
        (f"({b64(OPENSSH)})", "openssh", b64(OPENSSH)),
        ("a\n-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(RSA))) + "\n-----END RSA PRIVATE KEY-----\nb", "der", None),
    ],
)
def test_confirmed_spans(text, kind, found):
    _, more = scanner()(text)
    assert [KINDS[k] for _, k, _ in more] == [kind]
    if found:
        assert text[more[0][0] : more[0][2]] == found


def test_random_runs_are_not_reported():
    scan = scanner()
    for n in range(30, 300, 7):
        assert scan(f"x {b64(RNG.randbytes(n))} {RNG.randbytes(n).hex().upper()} a.{b64(RNG.randbytes(12))}.c")[1] == []


def brute(text):
    kinds = [
        (r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, lambda m: len(m[1]) >= 6),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]
    found = []
    for rank, (pattern, flags, good) in enumerate(kinds):
        found += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text, flags & ~re.A) if good(m)]
    return sorted(found)


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op5_secrets(spark, sf).collect():
        spans = brute(texts[r.doc_id])
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_random_base_texts():
    rng, scan = random.Random(3), scanner()
    bits = ["token", "Secret", "api_key", "=", ":", " ", '"', "AKIA", "ABCDEFGH1234567890", "deadbeef01", "zz", "\n", "password"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert scan(text)[0] == brute(text), text


def test_nulls_repeats_clashes_and_redaction(spark):
    df = spark.createDataFrame(
        [(1, None, 5, "k"), (1, "", 0, "k"), (2, "token = abcdef12 x", 18, None), (2, "token = abcdef12 x", 18, None), (None, "plain", None, "k")],
        "doc_id long, text string, n_chars long, secret_spans string",
    )
    assert scan_secrets(df, keep=["doc_id"]).count() == 5
    rows = redact_secrets(df).collect()
    assert redact_secrets(df).columns == df.columns
    assert sorted((str(r.text), str(r.n_chars)) for r in rows) == [
        ("", "0"), ("None", "5"), ("[SECRET] x", "10"), ("[SECRET] x", "10"), ("plain", "None")]
    assert redact_secrets(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Bearer {}. Next", "see {}.", "x.{}", "a-{}-", "id_{} b", "v1.file_name.{}, {}"])
def test_tokens_beside_punctuation(text):
    token = f"{url({'alg': 'HS256'})}.{url({'sub': '1'})}.abcDEF123"
    found = [text.format(token, token)[s:e].rstrip("-") for s, _, e in scanner()(text.format(token, token))[1]]
    assert found == [token] * text.count("{}")


WRAPPED = re.findall(".{1,64}", b64(PKCS8))
PEM = ["-----BEGIN PRIVATE KEY-----", *WRAPPED, "-----END PRIVATE KEY-----"]


@pytest.mark.parametrize(
    "text",
    [
        json.dumps({"key": "\n".join(PEM) + "\n"}), "\n".join("> " + x for x in PEM), "\n".join("# " + x for x in PEM),
        "k = (" + " +\n  ".join(f'"{x}\\n"' for x in PEM) + ")", "a b\n" + "\n".join(WRAPPED) + "\nc", "\\n".join(WRAPPED),
        "-----BEGIN X-----\n!! " + b64(RSA) + "\n-----END X-----",
    ],
)
def test_keys_in_strings_quotes_and_lines(text):
    more = scanner()(text)[1]
    assert {KINDS[k] for _, k, _ in more} == {"der"}
    left = text
    for s, _, e in reversed(more):
        left = left[:s] + left[e:]
    assert not any(x in left for x in WRAPPED)


@pytest.mark.parametrize("width", [16, 20, 33, 64, 76])
def test_wrapped_keys_of_any_width(width):
    for key, kind in ((PKCS8, "der"), (RSA, "der"), (OPENSSH, "openssh"), (PUBLIC, "public")):
        lines = re.findall(f".{{1,{width}}}", b64(key))
        for text in ("x\n" + "\n".join(lines) + "\nend of it", "k=" + "\\n".join(lines), "\n".join(lines * 2), "\n\n".join("// " + x for x in lines)):
            more = scanner()(text)[1]
            assert {KINDS[k] for _, k, _ in more} == {kind}, (width, text)
            assert all(text[s:e].startswith(lines[0]) and text[s:e].endswith(lines[-1]) for s, _, e in more)
            assert len(more) == (2 if text == "\n".join(lines * 2) else 1) or len(lines[-1]) == width


def test_public_keys_are_reported_and_stay(spark):
    text = "a " + b64(PUBLIC) + " token=abcdef12"
    assert [KINDS[k] for _, k, _ in scanner()(text)[1]] == ["public"]
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    assert redact_secrets(df).first().text == "a " + b64(PUBLIC) + " [SECRET]"


HOSTILE = {
    "blanks": "abcdefghijklmnopqrst" + " " * 1_000_000, "first line and blanks": "MIIEabcdefghijklmnop" + " " * 1_000_000 + "\nx",
    "quoted": "MIIEabcdefghijklmnop\n" + "> " * 500_000, "quotes": "MIIEabcdefghijklmnop" + "\"' " * 330_000, "pluses": "MIIEabcdefghijklmnop" + " + " * 330_000,
    "headers": "a.-" + "-ewAA" * 200_000 + ".e30.x", "headers and braces": ("-eyJh" * 4_000 + ".e30.x ") * 50, "letters": "." + "a" * 1_000_000, "dots": "abcdefghijklmnopqrst" + "." * 1_000_000,
    "heads": "-----BEGIN X-----" * 60_000, "armour of blanks": "-----BEGIN X-----" + " " * 1_000_000 + "-----END X-----",
    "armour of quotes": "-----BEGIN X-----" + "\n> \" " * 200_000 + "-----END X-----", "backslashes": "MIIEabcdefghijklmnop" + "\\" * 1_000_000,
    "returns": "MIIEabcdefghijklmnop" + "\\r" * 500_000, "sequences": "MIIEabcdefghijkl\n" * 60_000, "nested": (b64(b"\x30\x83\x00\xff\xff" + b"\x30\x02\x05\x00" * 20)[:64] + "\n") * 16_000,
    "assign": "token" + " " * 1_000_000, "many assigns": "token " * 170_000, "hex": "a" * 1_000_001, "lines": "MIIEabcdefghijklmnop\n" + "\n" * 1_000_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_takes_no_longer_than_its_length(name):
    from time import process_time

    scan = scanner()
    start = process_time()
    scan(HOSTILE[name])
    assert process_time() - start < 4  # about a second on a free core
