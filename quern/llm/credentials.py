"""Credentials embedded in source code: find, confirm across the corpus, redact.

1. Every file yields literals in the positions in which credentials stand (assignments, calls,
   headers, connection strings, command lines, prose), and values of known token formats.
2. Literals are counted by owner over the whole corpus. One that many owners share is a
   placeholder, unless a token format confirms it.
3. Every file is scanned again, by an automaton over the confirmed values that files of its
   block hold, so that a value is also found where nothing around it tells what it is.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed

MANY_OWNERS = 0.02  # a shapeless literal in this share of all scopes, and in FEW_OWNERS at least, is a placeholder
FEW_OWNERS = 5
LEAST_LENGTH = 6

# Words that name a credential, as part of an identifier.
NAME = (
    r"(?:pass(?:wor[dt]|wd|phrase|code)?|pwd|pw|contrase[nñ]a|mot_?de_?passe|kennwort|clave|secret|token|"
    r"api[_-]?key|access[_-]?key(?:[_-]?id)?|(?:stripe|signing|encryption|account|master|private|auth|app)[_-]?key|"
    r"credentials?|sendgrid|x[_-]?access|jwt|bearer|oauth2?[_-]?bearer)"
)
# An identifier ending in such a word, or in one followed by a plain qualifier.
KEY = rf"(?<![A-Za-z])[A-Za-z0-9_.-]{{0,40}}?{NAME}(?:_?(?:value|text|default|id|prod|live|staging|test|old|new|v?\d))?(?![A-Za-z0-9])"
# Formats that tell a token by itself.
FORMATS = {
    "aws_key_id": r"A(?:KIA|SIA)[0-9A-Z]{16}",
    "github": r"gh[pousr]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{40,}",
    "gitlab": r"gl(?:pat|dt|rt)-[0-9A-Za-z_-]{18,}",
    "vault": r"hvs\.[0-9A-Za-z_-]{20,}",
    "openai": r"sk-(?:proj-)?[0-9A-Za-z_-]{20,}",
    "stripe": r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "slack": r"xox[abposr]-[0-9A-Za-z-]{16,}",
    "sendgrid": r"SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}",
    "google": r"AIza[0-9A-Za-z_-]{33,}",
    "npm": r"npm_[0-9A-Za-z]{30,}",
    "jwt": r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
}
# A token by its structure: a short name, then many letters and digits of no pattern.
SHAPED = re.compile(r"(?<![0-9A-Za-z_/.+-])(?!pk)[a-z][a-z0-9]{1,11}(?:[_-][a-z]{2,8}){0,2}[_-](?P<v>[0-9A-Za-z]{20,})(?![0-9A-Za-z_/.+=-])")
LEAST_ENTROPY = 3.4  # bits a character
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# A line of key material, after what may stand before it: breaks (also escaped), quotes, comment signs, header lines.
KEY_LINE = re.compile(
    r"(?:\\[rnt]|[\s'\"`,\\]|\+(?=[\s'\"`])|(?<=[\n \t])(?:[#;>*|]|//|--)(?=[ \t])|(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset)[ \t]*:[^\r\n\\'\"]*)*+"
    r"(?P<v>[A-Za-z0-9+/]+={0,2})(?P<whole>(?=[ \t]*(?:\\[rn]|[\r\n'\"`]|\Z)))?"
)
FULL_LINE = 40
STRUCTURED = re.compile("(?<![0-9A-Za-z_])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items()) + r")(?![0-9A-Za-z])")
# What stands for a value instead of being one.
STAND_IN = re.compile(
    r"(?i)\A(?:\$|%\(|\{\{|<|\[redacted|\*+\Z|x{4,}\Z|\.{3,}\Z|-+\Z|_+\Z|#+\Z|:'|&|@|env[.:]|vault[.:]|ssm:|secret[s]?[/:.]|file:|/run/|/etc/|\./|~/)"
    r"|(?i:your|change[_-]?me|placeholder|example|dummy|redacted|insert[_-]|not[_-]?set|todo\b|fake|sample|\bnone\b|\bnull\b|undefined)"
    r"|\A(?i:true|false|yes|no|on|off|required|optional|missing|string|str|bytes|int|bool|password|passwd|secret|token|api_?key|auth_?token|getpass|process|os|self|config|settings|req|request|args|env|nil|never|stored|value)\Z"
    r"|\A(?:process\.env|os\.|sys\.|self\.|config\.|settings\.|args\.|req\.|env\.|store/|getpass\(|os\.getenv|vault |\w+\()"
)
QUOTED = r"[rbuRBU]{0,2}(?P<q>['\"`])(?P<v>(?:(?!(?P=q))[^\r\n]){4,})(?P=q)"


def _rx(p: str, flags: int = 0) -> re.Pattern:
    return re.compile(p, flags | re.IGNORECASE | re.MULTILINE)


# Each pattern has the value as its group v, as group h if it is a header value, or as group r if it must be random. Values are of any length, up to
# their delimiter.
PLACES = [
    # key = "value", "key": "value", key: str = r"value", key = ("value", cfg.Key = `value`, key="value" attributes
    _rx(rf"{KEY}['\"]?\]?\s{{0,4}}(?::\s*(?:str|string|bytes|&str|String)\s*)?(?::=|=>|=|:)\s{{0,4}}\(?\s{{0,4}}{QUOTED}"),
    # key=value, key: value on lines of their own, also commented out
    _rx(rf"^[ \t]*(?:[#;/*-]+[ \t]*)?(?:(?:TODO|FIXME|XXX)\b[^\r\n=:]{{0,20}}[ \t])?(?:export[ \t]+|set[ \t]+)?(?P<k>{KEY})[ \t]*[:=][ \t]*(?P<v>[^\s'\"`{{\[(<|>][^\s]{{3,}}?)[,;]?(?:[ \t]+[#;/][^\r\n]*)?[ \t]*\r?$"),
    # flow mappings and ini comments: {key: value}, "; key value"
    _rx(rf"[{{,][ \t]*(?P<k>{KEY})[ \t]*:[ \t]*(?P<v>[^\s'\"{{}},]{{6,}})[ \t]*[,}}]"),
    _rx(rf"^[ \t]*[;#][ \t]*(?P<k>{KEY})[ \t]+(?P<v>[^\s=:]{{6,}})[ \t]*\r?$"),
    # block scalars: the value starts on the next line
    _rx(rf"^[ \t]*(?:-[ \t]+)?['\"]?(?P<k>{KEY})['\"]?:[ \t]*[>|][+-]?[ \t]*\r?\n[ \t]+(?P<v>[^\s]{{5,}})[ \t]*\r?$"),
    # names and values side by side
    _rx(rf"name['\"]?\s*[:=]\s*['\"]?{KEY}['\"]?\s*,?\s*['\"]?value['\"]?\s*[:=]\s*(?P<q>['\"]?)(?P<v>[^\s'\"]{{5,}})(?P=q)"),
    _rx(rf"\bkey['\"]?\s*[:=]\s*['\"]{KEY}['\"]\s*,?\s*['\"]?value['\"]?\s*[:=]\s*{QUOTED}"),
    _rx(rf"<(?P<k>{KEY})>\s*(?P<v>[^\s<>]{{5,}})\s*</"),
    _rx(rf"\(\s*['\"](?:x-)?{KEY}['\"]\s*,\s*{QUOTED}"),
    _rx(rf"\[['\"]{KEY}['\"]\]\s*=\s*{QUOTED}"),
    _rx(rf"process\.env\.{KEY}\s*(?:\|\||\?\?)\s*{QUOTED}"),
    # keys of any other name, if the value is random
    _rx(r"(?<![A-Za-z0-9])[A-Za-z0-9_.-]{0,40}[A-Za-z0-9][_-]?key['\"]?\]?[ \t]*(?::=|=>|=|:)[ \t]*\(?[ \t]*(?P<q>['\"`]?)(?P<r>[0-9A-Za-z_-]{10,})(?P=q)(?![^\s,;)}\]])"),
    # calls and statements
    _rx(rf"\bauth\s*=\s*\(\s*['\"][^'\"]{{1,60}}['\"]\s*,\s*{QUOTED}"),
    _rx(rf"\b(?:sdk|client|api)\.(?:init|login|configure|connect)\(\s*{QUOTED}"),
    _rx(rf"\b(?:IDENTIFIED\s+BY|PASSWORD)\s+{QUOTED}"),
    # connection strings: the part between user and host; a value with an at-sign ends at the last one before the host
    _rx(r"[a-z][a-z0-9+.-]{1,30}://[^\s:/@'\"`<>]{0,60}:(?P<v>[^\s@'\"`<>]{3,}+(?:@[^\s/@'\"`<>]*(?=@))*)@[\w.-]+"),
    _rx(rf"[?&](?:{KEY}|key|sig|signature|code|access)=(?P<v>[^\s&'\"`<>#]{{6,}})"),
    # headers
    _rx(r"\b(?:Bearer|Basic|Token)[ \t]+(?P<h>[A-Za-z0-9+/=_.!#$%^&*~-]{6,})"),
    # command lines
    _rx(r"\bcurl\b[^\r\n]{0,80}?\s(?:-u|--user)[ \t]*['\"]?[^\s:'\"]{1,60}:(?P<v>[^\s'\"`]{4,})"),
    _rx(r"\b(?:mysql|mysqldump|psql|sshpass|mongo|redis-cli)\b[^\r\n]{0,80}?\s-[pa][ \t]?(?P<q>['\"]?)(?P<v>(?!(?:app|svc|root)\b)[^\s'\"]{4,})(?P=q)"),
    _rx(rf"--[a-z0-9-]{{0,30}}(?:{NAME})[= \t](?P<q>['\"]?)(?P<v>[^\s'\"]{{4,}})(?P=q)"),
    _rx(r"\becho[ \t]+(?:-n[ \t]+)?['\"]?(?P<v>[^\s'\"]{5,})['\"]?[ \t]*\|[^\r\n]{0,60}\b(?:login|passwd|stdin)"),
    _rx(r"\bmachine[ \t]+\S+[ \t]+login[ \t]+\S+[ \t]+password[ \t]+(?P<v>\S{4,})"),
    _rx(r"<<-?[ \t]*['\"]?(?P<e>[A-Z]{2,10})['\"]?[ \t]*\r?\n(?P<v>\S{5,})[ \t]*\r?\n(?P=e)\b"),
    # prose
    _rx(rf"{KEY}[ \t]+(?:is|was|ist|es|est|lautet)[ \t]*:?[ \t]*[`'\"](?P<v>[^\s`'\"]{{4,}})[`'\"]"),
    _rx(rf"{KEY}[ \t]+(?:\*\*|`)(?P<v>[^\s`]{{4,}}?)(?:\*\*|`)(?![*])"),
    _rx(rf"\blogin:[ \t]*\S{{1,60}}[ \t]*/[ \t]*(?P<v>\S{{4,}})[ \t]+\((?:{KEY}|[\w-]{{1,40}}key)\)"),
]
# Every match of PLACES has one of these, in lower case, on its first line or on the line its value starts on
# or one between. Each of NAME's words holds one; a test matches every pattern and word against them.
HINTS = (
    "pass", "pwd", "pw", "contrase", "mot_de", "motde", "kennwort", "clave", "secret", "token", "key", "access", "credential", "sendgrid", "jwt", "bearer",
    "basic", "auth", "://", "login", ".init(", ".configure(", ".connect(", "identified", "mysql", "psql", "mongo", "redis-cli", "curl", "echo", "<<", "machine",
    "?sig", "&sig", "?code=", "&code=",
)
PREFIXES = ("AKIA", "ASIA", "gh", "gl", "hvs.", "sk-", "k_live_", "k_test_", "xox", "SG.", "AIza", "npm_", "eyJ")
REACH = 3  # lines that aren't blank, the hint's own included
# Names that hold something about a credential rather than one.
ABOUT = re.compile(r"(?i)(?:_|-|\b)(?:ref|file|path|hash|hashes|count|timeout|min|max|length|len|url|uri|type|name|policy|ttl|expiry|limit|field|env|var)(?:_|\b)|public|(?:tokeni[sz]e)")


def decoded(value: str) -> str:
    """Secret part of a Basic header's value, or the value itself."""
    try:
        t = base64.b64decode(value, validate=True).decode()
    except ValueError:
        return value
    return t.split(":", 1)[1] if ":" in t else value


def plausible(value: str, name: str = "") -> bool:
    """Whether a literal in a credential's place can be one."""
    if len(value) < LEAST_LENGTH - 2 or STAND_IN.search(value) or ABOUT.search(name):
        return False
    if len(set(value)) < 3 or not re.search(r"[A-Za-z0-9]", value):
        return False
    return not re.fullmatch(r"\d{1,5}|[\d.]+|v?\d+(\.\d+)+", value)


def is_random(value: str, least: int = 3) -> bool:
    """Whether letters and digits (so many at least) are mixed as in a generated value; hexadecimal digests and ids aren't."""
    digits = sum(map(str.isdigit, value))
    if digits < least or len(value) - digits < 5 or re.fullmatch(r"(?i)[0-9a-f]+", value):
        return False
    n = [value.count(c) / len(value) for c in set(value)]
    return -sum(x * math.log2(x) for x in n) >= min(LEAST_ENTROPY, 0.8 * math.log2(len(value)))


# The rest of a literal that goes on in another one, on the same or the next line.
REST = re.compile(r"[ \t]*\+?[ \t]*(?:\\\r?\n|\r?\n)?[ \t]*[rbuRBU]{0,2}(['\"`])((?:(?!\1)[^\r\n])+)\1")


def key_lines(text: str, at: int, stop: int) -> list[tuple[int, int]]:
    """Lines of key material that follow a header without an end line, up to the first that isn't any."""
    out: list[tuple[int, int]] = []
    while m := KEY_LINE.match(text, at, stop):
        v = m["v"]
        mixed = re.search(r"[0-9]", v) and re.search(r"[A-Za-z]", v) or not (v.islower() or v.isupper() or v.istitle())
        if len(v) < FULL_LINE:
            # The last line is shorter. A plain word or a mark such as EOT is none.
            last = out and m["whole"] is not None and (v.endswith("=") or mixed and (len(v) >= 16 or m.end("v") == len(text)))
            if not (last or not out and mixed and len(v) >= 16):
                break
        out.append(m.span("v"))
        at = m.end("v")
    return out


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, value, kind) of each literal in a credential's place; kind 'format' needs no confirmation.

    The rest of a literal that goes on in a second one has kind 'rest' and no value, and so have the lines of
    a private key without an end line.
    """
    out = []
    for m in KEY_BLOCK.finditer(text):
        # A header alone isn't a key: material must follow.
        end = KEY_END.search(text, m.end())
        after = KEY_BLOCK.search(text, m.end())
        if end and after and after.start() < end.start():
            end = None  # it ends another key
        stop = after.start() if after else len(text)
        body = text[m.end() : end.start() if end else stop]
        letters = re.sub(r"\\n|\s|['\"+,\\]", "", body)
        if len(re.findall(r"[A-Za-z0-9+/=]", letters)) >= 20 and not STAND_IN.search(letters[:40]):
            out.append((m.start(), end.end() if end else m.end(), "", "format"))
            if not end:
                out += [(s, e, "", "rest") for s, e in key_lines(text, m.end(), stop)]
    blocks = [(s, e) for s, e, _, _ in out]
    if any(x in text for x in PREFIXES):
        for m in STRUCTURED.finditer(text):
            if plausible(m.group()):
                out.append((m.start(), m.end(), m.group(), "format"))
    if "_" in text or "-" in text:
        out += [(m.start(), m.end(), m.group(), "place") for m in SHAPED.finditer(text) if is_random(m["v"]) and plausible(m.group())]
    for a, b in windows(text):
        for rx in PLACES:
            for m in rx.finditer(text, a, b):
                g = m.groupdict()
                group = next(x for x in "hrv" if g.get(x))
                s, e = m.span(group)
                if any(x <= s < y for x, y in blocks) or (group == "r" and not is_random(g["r"], 2)):
                    continue
                name = g.get("k") or (text[m.start() : s] if group == "v" else "")
                names = [x for x in re.split(r"[^\w-]+", name) if x]
                if plausible(m.group(group), names[-1] if names else ""):
                    out.append((s, e, m.group(group), "place"))
                    # A rest follows a plus sign, or an opening parenthesis without its closing one.
                    if g.get("q") and (more := REST.match(text, m.end())) and ("+" in more.group() or re.search(r"\(\s*[rbuRBU]{0,2}['\"`]\Z", text[m.start() : s])):
                        out.append((*more.span(2), "", "rest"))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of whole lines in which a credential can stand."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    here = [h for h in HINTS if h in low]
    if not here:
        return []
    out: list[tuple[int, int]] = []
    lines = low.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    for n, x in enumerate(lines):
        if any(h in x for h in here):
            end, left = n + 1, REACH - 1
            while end < len(lines) and left:
                left -= bool(lines[end].strip())
                end += 1
            a, b = starts[n], min(starts[end], len(text))
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def line_of(text: str, at: int) -> int:
    """Line number of a position, from 1."""
    return text.count("\n", 0, at) + 1


# --- over a whole table -------------------------------------------------------------------------

SPANS = "k bigint, start int, stop int, line int, value string, kind string"
ANCHOR = 8  # bytes; a value is looked for by its last so many, and where it has them by as many before
SHORT = (6, 7)  # bytes of shorter values that are looked for as well, if they are structured
LEAST_BITS, MOST_BITS = 16, 27
BLOCK_BITS = 16
MOST_ANCHORS = 1 << 24  # in one bit table; more are looked for in several passes


def spans(files: DataFrame) -> DataFrame:
    """Literals in credentials' places of files (k bigint, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, line = [], 0
            for k, t in zip(b["k"], b["content"]):
                for s, e, v, kind in candidates(t) if t else ():
                    # A credential over several lines counts where it starts.
                    line = line if kind == "rest" else line_of(t, s)
                    rows.append((k, s, e, line, v, kind))
            yield pd.DataFrame(rows, columns=["k", "start", "stop", "line", "value", "kind"])

    return files.select("k", "content").mapInPandas(run, SPANS)


def confirmed(found: DataFrame, owners: DataFrame, many: float = MANY_OWNERS) -> DataFrame:
    """Values that are credentials: of a token format, or in a credential's place of few owners.

    ``found`` has (k, value, kind), ``owners`` (k, owner). Few is less than the share ``many`` of all
    owners, or than ``FEW_OWNERS``.
    """
    named = found.filter("value <> ''").join(owners, "k").select("value", "kind", "owner")
    # Counted in two steps, so that a placeholder of a third of all files meets itself early.
    once = named.groupBy("value", "owner").agg(F.max(F.col("kind") == "format").alias("shaped"))
    by = once.groupBy("value").agg(F.count("*").alias("n_owners"), F.max("shaped").alias("shaped"))
    most = max(FEW_OWNERS, math.ceil(many * owners.select("owner").distinct().count()))
    return by.filter(F.col("shaped") | (F.col("n_owners") < most)).select("value", "n_owners", "shaped")


def _number(raw: bytes) -> int:
    return int.from_bytes(raw[-ANCHOR:], "little", signed=True)


def structured(value: str) -> bool:
    """Whether a short value has letters, digits and, besides, capitals or signs, as ordinary words and numbers don't."""
    return bool(re.search(r"[a-z]", value) and re.search(r"[0-9]", value) and re.search(r"[^a-z0-9]", value))


def anchored(values: DataFrame) -> DataFrame:
    """(value, anchor, before, length): the numbers that the last bytes of a value and those before them make.

    ``before`` is null for values under two anchors. ``length`` is that of the anchor in bytes. Values under
    ``ANCHOR`` bytes are looked for only if they are structured: any other would be found in texts that mean
    something else.
    """
    shape = "anchor bigint, before bigint, length int"

    @F.pandas_udf(shape)
    def anchor(s: pd.Series) -> pd.DataFrame:
        rows = []
        for v in s:
            raw = v.encode()
            if len(raw) >= ANCHOR:
                rows.append((_number(raw), _number(raw[:-ANCHOR]) if len(raw) >= 2 * ANCHOR else None, ANCHOR))
            else:
                rows.append((_number(raw), None, len(raw) if len(raw) in SHORT and structured(v) else None))
        return pd.DataFrame(rows, columns=["anchor", "before", "length"]).astype({"before": "Int64", "length": "Int32"})

    return values.select("value", anchor("value").alias("a")).select("value", "a.*").filter("length IS NOT NULL")


def _slots(anchors, bits: int):
    import numpy as np

    return (anchors.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def anchor_filter(anchors: DataFrame, n: int):
    """Bit table of ``n`` anchors, of a size that follows their number, 2^27 bits (16 MB) at most."""
    import numpy as np

    bits = max(LEAST_BITS, min(MOST_BITS, (64 * max(n, 1)).bit_length()))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = _slots(b["anchor"].to_numpy(), bits)
            yield pd.DataFrame({"block": (at >> np.uint64(BLOCK_BITS)).astype("i4"), "slot": (at & np.uint64((1 << BLOCK_BITS) - 1)).astype("i4")})

    def table(g: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros(1 << BLOCK_BITS, dtype="u1")
        t[g["slot"].to_numpy()] = 1
        return pd.DataFrame({"block": [g["block"].iloc[0]], "bits": [np.packbits(t).tobytes()]})

    rows = anchors.select("anchor").mapInPandas(blocks, "block int, slot int").distinct().groupBy("block").applyInPandas(table, "block int, bits binary").collect()
    out = np.zeros((1 << bits) >> 3, dtype="u1")
    size = (1 << BLOCK_BITS) >> 3
    for r in rows:
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, "u1")
    return bits, out


def likely_files(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """(k, value) of files that hold a value's last bytes, and those before, at the end of a word somewhere.

    Files are read once per ``MOST_ANCHORS`` values, so that the bit table never fills up.
    """
    n = anchors.count()
    passes = max(1, -(-n // MOST_ANCHORS))
    out = None
    for i in range(passes):
        part = anchors if passes == 1 else anchors.filter(F.pmod(F.xxhash64("anchor"), F.lit(passes)) == i)
        found = _likely_files(files, part, n // passes)
        out = found if out is None else out.unionByName(found)
    return out


def _likely_files(files: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    import numpy as np

    bits, found = anchor_filter(anchors, n)
    shared = files.sparkSession.sparkContext.broadcast(found)
    lengths = sorted(r.length for r in anchors.select("length").distinct().collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        # Bytes of ASCII words; a value ends where a word does.
        word = np.zeros(256, dtype=bool)
        word[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
        for b in batches:
            raw = [(t or "").encode() for t in b["content"]]
            ends = np.cumsum([len(r) for r in raw])
            # One more number before each text than it has, so that a first one has something before it.
            flat = b"\0" * ANCHOR + b"".join(raw)
            inside = word[np.frombuffer(flat, "u1")]
            stop = np.append(~(inside[:-1] & inside[1:]), True)
            starts = np.cumsum([0, *(len(r) for r in raw)])
            stop[starts[1:] + ANCHOR - 1] = True
            out = []
            for o in range(ANCHOR):
                m = (len(flat) - o) // ANCHOR
                a = np.frombuffer(flat, "<i8", m, o)
                at = np.flatnonzero(stop[o + ANCHOR - 1 :: ANCHOR][:m])
                for size in lengths:
                    x = a[at] if size == ANCHOR else (a[at].view("u8") >> np.uint64(8 * (ANCHOR - size))).astype("i8")
                    s = _slots(x, bits)
                    yes = ((known[s >> np.uint64(3)] >> (np.uint64(7) - (s & np.uint64(7))).astype("u1")) & 1).astype(bool)
                    hit = at[yes]
                    k = np.searchsorted(ends, np.maximum(hit * ANCHOR + o - 1, 0), "right")
                    before = np.where(hit > 0, a[np.maximum(hit - 1, 0)], 0)
                    out.append(pd.DataFrame({"k": b["k"].to_numpy()[np.minimum(k, len(raw) - 1)], "anchor": x[yes], "before": before, "length": size}))
            if out:
                yield pd.concat(out).drop_duplicates()

    at = files.select("k", "content").mapInPandas(run, "k bigint, anchor bigint, before bigint, length int")
    long = at.join(anchors.filter("before IS NOT NULL"), ["anchor", "before", "length"])
    short = at.drop("before").join(anchors.filter("before IS NULL").drop("before"), ["anchor", "length"])
    return long.select("k", "value").unionByName(short.select("k", "value")).distinct()


def rescan(files: DataFrame, values: DataFrame) -> DataFrame:
    """Every occurrence of confirmed values: (k, start, stop, line).

    Files that can hold any are found by anchors; an automaton over the values of a batch of such
    files then finds each place. A place inside a longer word doesn't count.
    """
    # The values of a file: few, as each stands in it.
    per_file = likely_files(files, anchored(values)).groupBy("k").agg(F.collect_set("value").alias("own"))
    todo = files.select("k", "content").join(per_file, "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        for b in batches:
            machine = ahocorasick.Automaton()
            for own in b["own"]:
                for v in own:
                    machine.add_word(v, len(v))
            machine.make_automaton()
            rows = []
            for k, t in zip(b["k"], b["content"]):
                for end, n in machine.iter(t):
                    s, e = end - n + 1, end + 1
                    if (s and t[s - 1].isalnum() and t[s].isalnum()) or (e < len(t) and t[e].isalnum() and t[e - 1].isalnum()):
                        continue
                    rows.append((k, s, e, line_of(t, s)))
            yield pd.DataFrame(rows, columns=["k", "start", "stop", "line"])

    return todo.mapInPandas(run, "k bigint, start int, stop int, line int")


def find(df: DataFrame, key: str = "seq", text: str = "content", owner: str = "scope_key", many: float = MANY_OWNERS) -> DataFrame:
    """Places of credentials: rows (k, start, stop, line), positions in code points of the whole text.

    ``key`` must be a unique number. Null and empty texts have none. Texts of any length are scanned
    whole; repeated rows are found alike; other columns are dropped.
    """
    files = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("content"))
    found = checkpointed(spans(files))
    values = checkpointed(confirmed(found, df.select(F.col(key).cast("bigint").alias("k"), F.col(owner).alias("owner")), many))
    own = found.filter("value = ''").select("k", "start", "stop", "line").unionByName(
        found.join(values.select("value"), "value", "left_semi").select("k", "start", "stop", "line")
    )
    return own.unionByName(rescan(files, values)).distinct()


def redact(df: DataFrame, places: DataFrame, key: str = "seq", text: str = "content", out: str = "redacted") -> DataFrame:
    """The table with ``out``: the text with each place replaced by a mark of word characters.

    Quotes, separators and line structure around a value stay, and line breaks inside it are kept, so
    the surrounding code stays well-formed. A column named ``out`` is replaced.
    """
    by = places.groupBy("k").agg(F.collect_set(F.struct("start", "stop")).alias("__places"))
    j = df.drop(out).join(by.withColumnRenamed("k", "__k"), F.col(key) == F.col("__k"), "left").drop("__k")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, all_places: pd.Series) -> pd.Series:
        # The function sees rows without places too.
        return pd.Series([t if t is None or p is None else redacted(t, [(x["start"], x["stop"]) for x in p]) for t, p in zip(texts, all_places)])

    return j.withColumn(out, F.when(F.col("__places").isNull(), F.col(text)).otherwise(cut(text, "__places"))).drop("__places")


MARK = "REDACTED_CREDENTIAL"


def redacted(text: str, places: list[tuple[int, int]]) -> str:
    """Text with the places, which may overlap, replaced."""
    merged: list[list[int]] = []
    for s, e in sorted(places):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, at = [], 0
    for s, e in merged:
        old = text[s:e]
        breaks = re.findall(r"\r?\n|\\n", old)
        out += [text[at:s], MARK, *breaks]
        at = e
    return "".join([*out, text[at:]])
