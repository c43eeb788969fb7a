"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

Three patterns give the base spans. The method adds others: behind a word of sensitive context (key,
secret, credential ...) a candidate string of 16 or more key characters is compressed by Zstandard behind its surrounding text, primed with a dictionary of
common identifiers and of the words that the text itself repeats. Its marginal bytes, that is
the frame with it less the frame without it, tell novelty: an identifier or a word met nearby costs a few bytes,
a random key most of its entropy. Candidates above ``min_ratio`` marginal bytes a character are reported as 'novel'. Base spans are measured
too (``base_bytes``), and stay whatever they cost. Paths and names made of words with numbers behind or before them aren't candidates.

Null and empty texts have no spans. Spans are in code points, end exclusive. No row leaves its task,
so hot sources and copies need no care; other columns are not read by ``scan``. Repeated rows are scanned alike; spans that begin together
are in the order of their kinds. A text is one row of one task, searched in time in proportion to it: a run of key characters is cut at the words of context in it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_whole, rows_map, small_batches

#: Fixed patterns of the base, by kind, in the order that ties follow.
ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make the text behind them sensitive.
CONTEXT = (b"secret", b"token", b"passw", b"pwd", b"api", b"key", b"credential", b"bearer", b"auth", b"private")
#: All of ``CONTEXT``; 'key' stands for api key, access-key, private_key and the like.
_CONTEXT = re.compile(f"(?i:{b'|'.join(CONTEXT).decode()})", re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST = 16


#: What parts a path or a name, and a part that is a word or a number, or one beside the other.
_BREAKS, _PLAIN = re.compile(r"[/_=+-]+"), re.compile(r"[0-9]{0,4}[A-Za-z]?[a-z]*[0-9]{0,4}")


def keylike(s: str) -> bool:
    """Whether the measure may decide: LEAST characters in parts that aren't plain words, with a digit, or where upper and lower case change at a third or more of the pairs of letters.

    Long words in letters alone cost as many bytes as the shortest random strings do.
    """
    odd = [p for p in _BREAKS.split(s) if not _PLAIN.fullmatch(p)]
    if sum(map(len, odd)) < LEAST:
        return False
    if re.search("[0-9]", s):
        return True
    case = [c.isupper() for c in s if c.isalpha()]
    return len(case) > 1 and 3 * sum(a != b for a, b in zip(case, case[1:])) >= len(case) - 1


#: Identifiers and phrases that are common in code and configuration, for the dictionary.
IDENTIFIERS = (
    "import export default function return const public static private protected class struct interface "
    "authentication authorization authenticate authorized credentials credential certificate configuration "
    "password_hash password_reset reset_password token_type token_expiry access_token refresh_token id_token "
    "secret_name secret_manager secret_access_key aws_access_key_id aws_secret_access_key private_key public_key "
    "api_key api_key_id api_version application environment parameters session_id session_token user_name "
    "bearer_token authorization_header content_type connection_string database_url client_id client_secret "
    "example_key_here your_api_key your_token_here changeme placeholder undefined null true false "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 http:// https:// www. .com .org .net "
)


#: Words of letters that a text repeats, and how many of the commonest (ties: by the word) join the dictionary of its candidates.
_NAME, NAMES = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z_]{4,32}(?![A-Za-z0-9+/=_-])"), 200


class Novelty:
    """Marginal compressed bytes of a string behind its surroundings; ``of`` a text, also behind the words that it repeats."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        import zstandard

        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.identifiers, self.level = identifiers, level
        self.size = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False)

    def of(self, text: str) -> Novelty:
        often = [(-n, w) for w, n in Counter(_NAME.findall(text)).items() if n > 1]
        return Novelty(f"{' '.join(w for _, w in sorted(often)[:NAMES])} {self.identifiers}", self.level) if often else self

    def marginal(self, before: str, candidate: str, after: str) -> int:
        near = (before + " " + after).encode("utf-8", "surrogatepass")
        return len(self.size.compress(near + candidate.encode("utf-8", "surrogatepass"))) - len(self.size.compress(near))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three patterns. A quick look for their parts comes first; it drops nothing."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in (b"passw", b"secret", b"token", b"api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def novel_spans(text: str, known: list, novelty: Novelty, reach: int, around: int, min_ratio: float) -> list[tuple[int, str, int]]:
    """Candidates within ``reach`` characters behind a context word that share nothing with a known span.

    A candidate ends with its run of key characters, or is measured up to the next context word in the run; if it is novel, it is
    reported to the end of the run.
    """
    low = text.encode("utf-8", "surrogatepass").lower()
    if not any(w in low for w in CONTEXT):
        return []
    words = [m.span() for m in _CONTEXT.finditer(text)]
    starts, taken = [a for a, _ in words], sorted((a, b) for a, _, b in known)
    begins, ends = [a for a, _ in taken], [*accumulate((b for _, b in taken), max)]
    out: list = []
    run, past, mine = (0, 0), -1, None
    for _, word_end in words:
        at, limit = word_end, word_end + reach
        while at < limit:
            if not run[0] <= at < run[1]:  # words within a long run don't search it again
                m = _RUN.search(text, at)
                if not m:
                    break
                run = m.span()
            start, end = max(at, run[0]), run[1]
            at = end
            if start >= limit or end - start < LEAST or start <= past or out and start < out[-1][2]:
                continue
            past = start
            cut = bisect_left(starts, start + LEAST)
            piece = text[start : min(end, starts[cut])] if cut < len(starts) else text[start:end]
            near = bisect_left(begins, end)
            if near and ends[near - 1] > start or not keylike(piece):
                continue
            mine = mine or novelty.of(text)
            if mine.marginal(text[max(0, start - around) : start], piece, text[end : end + around]) >= min_ratio * len(piece):
                out.append((start, "novel", end))
    return out


def base_bytes(text: str, base: list, novelty: Novelty, around: int) -> list[int]:
    """Marginal bytes of each base span behind the text around it."""
    mine = novelty.of(text) if base else novelty
    return [mine.marginal(text[max(0, a - around) : a], text[a:b], text[b : b + around]) for a, _, b in base]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def _scanner(reach: int, around: int, min_ratio: float):
    novelty = Novelty()

    def both(text: str | None):
        base = base_spans(text or "")
        more = novel_spans(text or "", base, novelty, reach, around, min_ratio)
        return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[1]))), novelty

    return both


def scan(docs: DataFrame, reach: int = 48, around: int = 256, min_ratio: float = 0.5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel, base_bytes (marginal bytes of the base spans, comma-joined) of every whole text."""
    small_batches(docs.sparkSession)

    def make():
        both = _scanner(reach, around, min_ratio)

        def each(rows: dict) -> dict:
            pairs = [both(t) for t in rows["text"]]
            count = lambda kind, which: [sum(s[1] == kind for s in p[which]) for p in pairs]
            return {
                "doc_id": rows["doc_id"], "n_assign": count("assign", 0), "n_access": count("access", 0), "n_hex": count("hex", 0),
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, *_ in pairs],
                "spans": [joined(a) for _, a, _ in pairs], "n_novel": count("novel", 1),
                "base_bytes": [",".join(map(str, base_bytes(t or "", b, novelty, around))) for t, (b, _, novelty) in zip(rows["text"], pairs)],
            }

        return each

    return rows_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, base_bytes string")


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = 48, around: int = 256, min_ratio: float = 0.5) -> DataFrame:
    """``docs`` with every span's text replaced by ``mark`` (overlapping spans by one) and n_chars, if there, set anew.

    Every row and column stays; null texts stay null.
    """
    small_batches(docs.sparkSession)
    i, j = (docs.columns.index(c) if c in docs.columns else None for c in ("text", "n_chars"))

    def run(batches):
        import pyarrow as pa

        both = _scanner(reach, around, min_ratio)

        def clean(text):
            if text is None:
                return None
            done, at = [], 0
            for a, _, b in both(text)[1]:
                if a >= at:
                    done += [text[at:a], mark]
                at = max(at, b)
            return "".join([*done, text[at:]])

        for batch in batches:
            old = batch.column(i).to_pylist()
            new = [clean(t) for t in old]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            if j is not None:
                kept = batch.column(j).to_pylist()
                batch = batch.set_column(j, batch.schema.field(j), pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new)], batch.schema.field(j).type))
            yield batch

    return map_whole(docs, run)
