"""Secret scan with structural confirmation (operator 5).

Three patterns give the base findings. Beside them, runs of base64 or hex
letters are decoded and reported only where the bytes parse as a key:

* ``jwt``: a signed token, three base64url parts whose header is a JSON object with
  ``alg`` and whose payload is a JSON object;
* ``der``: an ASN.1 key (PKCS#1, PKCS#8, SEC 1 or encrypted PKCS#8) whose nested
  lengths fill the value exactly;
* ``openssh``: the private key container, its length-prefixed fields read to the end;
* ``public``: an ASN.1 public key. It is reported but no secret, so it is not redacted.

Armoured keys (``-----BEGIN ...-----``) are one candidate over their lines. Every search takes time in proportion to
the text, however it is made: no pattern has two optional runs that can share letters, a run of lines is decoded
once, and a key's own lengths say where it ends. A token's header is sought in the last ``MAX_HEADER`` letters.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import map_slices, table

KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "public")
MAX_HEADER = 4096
MAX_ELEMENTS = 64  # of one level of a key; the structures above have ten at most

ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ARMOUR = r"-----BEGIN ([A-Z ]{0,40})-----((?:[^-]|-(?!----))*+)-----END \1-----"
# A line's end, drawn or written as an escape.
LINE_END = r"(?<!\\)\\++(?:r\\++)?n|\r?\n"
# Marks of code, mail or comments before a line.
LEAD = r"(?:[\x20\t>#*|\"']|//(?=\x20)|\+(?=\x20))*+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
# The first line of a wrapped key: "M" begins a sequence, "b" the container's name.
FIRST_LINE = r"(?:(?<=\\n)|(?<=\\r)|(?<![A-Za-z0-9+/_\\-]))[Mb][A-Za-z0-9+/_-]{15}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}"
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}"
HEX_RUN = r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])"

# Object identifiers of key algorithms (fixed values): RSA, EC, DSA, Ed25519, X25519, PBES2.
KEY_OIDS = (
    "2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2b6570", "2b656e", "2a864886f70d01050d",
)


STANDARD = str.maketrans("-_", "+/")


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not."""
    body = text.rstrip("=").translate(STANDARD)
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def header(data: memoryview, at: int) -> tuple[int, int, int] | None:
    """(tag, first, end) of the definite-length element at a place; None if it doesn't lie within ``data``."""
    if at + 2 > len(data):
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= len(data) else None


def elements(data: memoryview) -> list[tuple[int, memoryview]] | None:
    """(tag, value) of consecutive elements that fill ``data``; None if they don't."""
    out, at = [], 0
    while at < len(data):
        found = header(data, at)
        if found is None or len(out) == MAX_ELEMENTS:
            return None
        tag, first, at = found
        out.append((tag, data[first:at]))
    return out


def der_key(data: memoryview) -> tuple[str, int] | None:
    """The kind of the key structure that ``data`` begins with and its size."""
    if len(data) < 20 or data[0] != 0x30:
        return None
    outer = header(data, 0)
    parts = elements(data[outer[1] : outer[2]]) if outer else None
    if not parts:
        return None
    tags = [t for t, _ in parts]
    ints = all(t == 2 and len(v) for t, v in parts)
    private = (
        (ints and len(parts) >= 9 and parts[0][1] in (b"\0", b"\1"))  # RSA
        or (ints and len(parts) == 6 and parts[0][1] == b"\0")  # DSA
        or (  # EC
            tags[:2] == [2, 4] and parts[0][1] == b"\1" and len(parts[1][1]) >= 16 and set(tags[2:]) <= {0xA0, 0xA1}
            and all(elements(v) is not None for _, v in parts[2:])
        )
        or (tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1") and names_key(parts[1][1]))  # PKCS#8
        or (tags == [0x30, 4] and names_key(parts[0][1]))  # encrypted PKCS#8
    )
    if private:
        return "der", outer[2]
    return ("public", outer[2]) if tags == [0x30, 3] and names_key(parts[0][1]) else None


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are exactly one key structure, private or public."""
    found = der_key(memoryview(data))
    return found is not None and found[1] == len(data)


def names_key(algorithm: memoryview) -> bool:
    inner = elements(algorithm)
    return bool(inner) and inner[0][0] == 6 and inner[0][1].hex() in KEY_OIDS


def openssh_size(data: memoryview) -> int | None:
    """Size of the private key container that ``data`` begins with."""
    magic = b"openssh-key-v1\0"
    if data[: len(magic)] != magic:
        return None
    at = len(magic)

    def field() -> memoryview | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        value = data[at + 4 : at + 4 + size]
        at += 4 + size
        return value

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return None
    return at if all([field() for _ in range(keys + 1)]) else None


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are a private key container whose fields end with the value."""
    return openssh_size(memoryview(data)) == len(data)


def key_at(data: memoryview) -> tuple[str, int] | None:
    """Kind and size of the key that ``data`` begins with."""
    if found := der_key(data):
        return found
    size = openssh_size(data)
    return ("openssh", size) if size else None


def key_kind(data: bytes | None) -> str | None:
    """Kind of the key that ``data`` is as a whole."""
    found = key_at(memoryview(data)) if data else None
    return found[0] if found and found[1] == len(data) else None


def json_object(part: str) -> dict | None:
    data = unbase64(part)
    try:
        parsed = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return parsed if isinstance(parsed, dict) else None


def names_algorithm(part: str) -> bool:
    parsed = json_object(part)
    return parsed is not None and isinstance(parsed.get("alg"), str)


def is_signed_token(head: str, payload: str) -> bool:
    return names_algorithm(head) and json_object(payload) is not None


def tokens(text: str, dotted: re.Pattern) -> list[tuple[int, int]]:
    """Spans of signed tokens. The header may follow other letters behind '.', '-' or '_', punctuation may follow the end."""
    found = []
    for m in dotted.finditer(text):
        parts = m[0].split(".")
        ends, at = [], m.start()
        for part in parts:
            ends.append(at + len(part))
            at = ends[-1] + 1
        i = 0
        while i + 2 < len(parts):
            head, payload = parts[i], parts[i + 1]
            start = None
            if len(head) >= 8 and len(payload) >= 4 and json_object(payload) is not None:
                low = max(0, len(head) - MAX_HEADER)
                starts = [0, *[x.end() for x in re.finditer(r"[-_](?=e[w-z])", head[low:])]]
                starts = [0, *[low + x for x in starts[1:]]]
                start = next((x for x in starts if len(head) - x >= 8 and names_algorithm(head[x:])), None)
            if start is None:
                i += 1
            else:
                found.append((ends[i] - len(head) + start, ends[i + 2]))
                i += 3
    return found


def bare(line: str, lead: re.Pattern) -> tuple[int, str]:
    """A line without the marks around it, and how many letters were before."""
    body = line.rstrip(" \t\r")
    if body.endswith("+") and body[-2:-1] in (" ", "\t", '"', "'"):
        body = body[:-1].rstrip(" \t")
    body = body.rstrip("\"',;")
    first = lead.match(body).end()
    return first, body[first:]


def unwrapped(body: str, line_end: re.Pattern, lead: re.Pattern) -> str:
    """The base64 of an armour's body; header lines and what is no base64 are left out."""
    lines = (bare(x, lead)[1].strip("\\") for x in line_end.split(body.replace("\\/", "/")))
    return "".join(y for x in lines if ":" not in x for y in x.split() if not y.strip("=").strip(LETTERS))


def wrapped_keys(text: str, line_end: re.Pattern, lead: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """Keys over lines of one length, the last of which may be shorter.

    The first line is the run of letters that ends a line, the last one the run that begins a line; lines with marks only don't count.
    """
    block: list[tuple[int, int]] = []
    width = 0
    for start, end in lines_of(text, line_end):
        first, body = bare(text[start:end], lead)
        if not body:
            continue
        start += first
        head = len(body) - len(body.lstrip(LETTERS))
        if block and head == len(body) == width:
            block.append((start, start + width))
            continue
        if block:
            yield from keys_of_block(text, block, width, (start, start + head) if head <= width else None)
        tail = len(body) - len(body.rstrip(LETTERS))
        at = start + len(body) - tail
        block, width = ([(at, at + tail)], tail) if tail >= 16 else ([], 0)
    if block:
        yield from keys_of_block(text, block, width, None)


def lines_of(text: str, line_end: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for m in line_end.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def keys_of_block(text: str, block: list[tuple[int, int]], width: int, last: tuple[int, int] | None) -> Iterator[tuple[int, int, str]]:
    """Keys that begin with a line of the block and end with one, or with ``last``."""
    begins = [k for k, (s, _) in enumerate(block) if text[s] in "Mb"]
    if not begins:
        return
    letters = "".join([text[s:e] for s, e in block] + ([text[last[0] : last[1]]] if last else [])).translate(STANDARD)
    decoded: dict[int, memoryview] = {}
    free = 0
    for k in begins:
        if k < free:
            continue
        at = k * width
        # Lines begin at four phases of the base64 letters at most, so the block is decoded four times at most.
        phase = at % 4
        if phase not in decoded:
            body = letters[phase : len(letters) - ((len(letters) - phase) % 4 == 1)]
            decoded[phase] = memoryview(base64.b64decode(body + "=" * (-len(body) % 4)))
        found = key_at(decoded[phase][(at - phase) // 4 * 3 :])
        if not found:
            continue
        stop = at + -(-found[1] * 4 // 3)
        if stop == len(letters) and last and last[1] > last[0]:
            end, free = last[1], len(block)
        elif stop % width == 0 and stop <= len(block) * width:
            free = stop // width
            end = block[free - 1][1]
        else:
            continue
        while text[end : end + 1] == "=":
            end += 1
        yield block[k][0], end, found[0]


def scanner() -> Callable[[str], tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """A function from a text to its base spans and its confirmed spans, (start, kind's rank, end)."""
    assign, access, hexes = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
    armour, run, token, hex_run = re.compile(ARMOUR), re.compile(RUN), re.compile(TOKEN), re.compile(HEX_RUN)
    line_end, lead, first_line = re.compile(LINE_END), re.compile(LEAD), re.compile(FIRST_LINE)
    names = ("passw", "secret", "token", "apikey", "api_key")
    rank = {k: i for i, k in enumerate(KINDS)}

    def scan(text: str):
        base: list[tuple[int, int, int]] = []
        more: set[tuple[int, int, int]] = set()
        lowered = text.lower()
        if any(n in lowered for n in names):
            base += [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(1) - m.start(1) >= 6]
        if "AKIA" in text:
            base += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= 20]
        armoured = []
        if "-----BEGIN " in text:
            for m in armour.finditer(text):
                if kind := key_kind(unbase64(unwrapped(m[2], line_end, lead))):
                    armoured.append(m.span())
                    more.add((m.start(), rank[kind], m.end()))
        # Every other kind needs a word of at least 16 characters.
        if max(map(len, text.split()), default=0) < 16:
            return sorted(base), sorted(more)
        base += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        if "." in text:
            more.update((s, rank["jwt"], e) for s, e in tokens(text, token))

        begins = [s for s, _ in armoured]

        def outside(start: int, end: int) -> bool:
            i = bisect_right(begins, start) - 1
            return i < 0 or end > armoured[i][1]

        for m in run.finditer(text):
            if outside(*m.span()) and (kind := key_kind(unbase64(m[0]))):
                more.add((m.start(), rank[kind], m.end()))
        if first_line.search(text):
            more.update((s, rank[kind], e) for s, e, kind in wrapped_keys(text, line_end, lead) if e - s >= 40 and outside(s, e))
        for m in hex_run.finditer(text):
            if outside(*m.span()) and (kind := key_kind(bytes.fromhex(m[0]))):
                more.add((m.start(), rank[kind], m.end()))
        return sorted(base), sorted(more)

    return scan


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with the findings of every whole text.

    ``secret_base`` and ``secret_spans``: arrays of (kind, start, end) in code points, end
    exclusive, by start and then kind as in ``KINDS``; the second holds both base and confirmed
    findings. A null or empty text has none; texts of any length are scanned whole, in time that grows with their length. Repeated rows are scanned alike; an empty table gives none.
    """

    def make():
        scan = scanner()

        def work(texts: list[str | None]) -> list[list]:
            base, spans = [], []
            for t in texts:
                b, m = scan(t or "")
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in b])
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(b + m)])
            return [base, spans]

        return work

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return map_slices(df, [text], make, f"secret_base {span}, secret_spans {span}", keep)


def redact_secrets(df: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret replaced by ``mark`` and ``length`` set to the new code points.

    Public keys stay. Overlapping spans become one mark. A text without a finding stays as it is, null included.
    """
    target = dict(df.dtypes)[length]
    public = KINDS.index("public")

    def make():
        scan = scanner()

        def work(texts: list[str | None], sizes: list) -> list[list]:
            out, lengths = [], []
            for t, n in zip(texts, sizes):
                base, more = scan(t or "")
                spans = sorted(base + [x for x in more if x[1] != public])
                if spans:
                    parts, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            parts += [t[at:s], mark]
                        at = max(at, e)
                    t = "".join(parts) + t[at:]
                    n = len(t)
                out.append(t)
                lengths.append(n)
            return [out, lengths]

        return work

    names = df.columns
    rest = [c for c in names if c not in (text, length)]
    made = map_slices(df, [text, length], make, f"`{text}` string, `{length}` {target}", rest)
    return made.select(*[F.col(f"`{c}`") for c in names])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``scan_secrets`` over all documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    line = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    count = lambda kind: F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line("secret_base").cast("binary"), 256).alias("base_sha256"),
        line("secret_spans").alias("spans"),
    )
