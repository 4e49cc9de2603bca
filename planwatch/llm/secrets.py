"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new in a sensitive context."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What makes the text that follows sensitive, and what may then be a secret.
SENSITIVE = re.compile(r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|signature)", re.A)
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=~$!@#%^&*-]{{{LEAST},}}")
#: Ordinary identifiers and values of code, which a candidate may consist of without being new.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key client_id client_secret credential credentials "
    "authorization authentication bearer basic signature session cookie header request response config configuration settings environment variable "
    "username user_name account database connection_string host localhost port server client service endpoint https http www example com org net "
    "production development staging testing default enabled disabled true false null none undefined placeholder changeme your_password_here "
    "process.env os.environ getenv import from return function const let var public static final class string integer boolean private protected "
    "aws azure google github gitlab docker kubernetes namespace region bucket table index column version timestamp created_at updated_at "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000000000000000 xxxxxxxxxxxxxxxxxxxx ********************"
)
#: Parts of long plain words of four languages, and of addresses, which are ordinary as well.
PLAIN = (
    "https://www. http://www. ftp://user@ mailto: info@ contact@ support@ noreply@ gmail.com outlook.com yahoo.com example.com/ github.com/ index.html .html .php .json "
    "documentation implementation communication international administration organization information recommendation representation application "
    "identification verification notification registration authentication infrastructure environmental development government management department "
    "requirements measurement establishment understanding understandable circumstances nevertheless independently approximately particularly immediately "
    "unfortunately significantly automatically responsibility availability compatibility university characteristic relationship membership interesting "
    "distinguished neighbourhood encyclopedia acknowledgement construction production distribution contribution introduction transformation performance "
    "conversation consideration professional traditional constitutional mathematical technological psychological philosophical extraordinary "
    "Entwicklung Verwaltung Wirtschaft Gesellschaft Wissenschaft Landschaft Mitgliedschaft Genehmigung Versicherung Veranstaltung Einrichtung Bezeichnung Untersuchung "
    "Verantwortung Zusammenarbeit Zusammenhang Ministerium Regierung Bundesrepublik Deutschland Bezirksverordnetenversammlung Bebauungsplan Stadtentwicklung "
    "verschiedenen unterschiedlich selbstverständlich wahrscheinlich insbesondere grundsätzlich möglicherweise entsprechend beziehungsweise wissenschaftlich "
    "Arbeitsplatz Krankenhaus Sicherheit Geschwindigkeit Möglichkeit Öffentlichkeit Wohnungsbau Grundstück Jahrhundert Unternehmen "
    "développement gouvernement établissement particulièrement malheureusement immédiatement actuellement connaissance correspondance intelligence "
    "bibliothèque responsabilité caractéristique internationale professionnelle administration environnement enseignement "
    "desarrollo conocimiento establecimiento funcionamiento procedimiento especialmente aproximadamente inmediatamente responsabilidad universidad posibilidad "
    "características internacional organización administración información comunicación presentación investigación construcción "
)


#: Parts of words and identifiers, as code joins them: runs of small letters, perhaps after a capital, or of capitals.
PART = "[A-Z]?[a-z]{3,}|[A-Z]{4,}"


def ordinary_parts(docs: DataFrame, text_col: str = "text", least_docs: int = 3, most_bytes: int = 16_000) -> str:
    """The parts of words and identifiers that most documents have, each in small letters and with a capital, the commonest last.

    Of parts in least_docs documents at least, as many as most_bytes hold: the size of a dictionary, whatever the corpus's. Each document's parts are counted
    where it is read; a part is shuffled once for each task that has it.
    """
    parts = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(f"({PART})"), F.lit(1)), F.lower))
    counts = docs.select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    size = 2 * F.octet_length("part") + 2
    rows = counts.orderBy(F.desc("n"), "part").limit(most_bytes // 8).select("part", size.alias("size")).collect()  # a part takes 8 bytes at least
    out, held = [], 0
    for r in rows:
        if held + r["size"] > most_bytes:
            break
        held += r["size"]
        out.append(f"{r['part'].capitalize()} {r['part']} ")
    return "".join(reversed(out))


def novelty(candidate: str, around: str, ordinary: str = "") -> int:
    """Compressed bytes that the candidate adds after what surrounds it, with words, identifiers and surroundings as a dictionary."""
    held = zstandard.ZstdCompressionDict((PLAIN + ordinary + IDENTIFIERS + around).encode(errors="replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=19, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
    tail = around[-32:]
    return len(pack.compress((tail + candidate).encode(errors="replace"))) - len(pack.compress(tail.encode(errors="replace")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns' matches."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def novel_spans(text: str, base: list[tuple[int, int, int]], near: int = 60, around: int = 400, least: float = 0.75, ordinary: str = "") -> list[tuple[int, int, int]]:
    """Spans, apart from the base ones, of strings that begin at most near characters after a sensitive word or end at most so many before it,
    and whose novelty is at least least bytes a character. Of a string that holds the word, what is before and what is after it count.

    ordinary: parts of words that the corpus knows (ordinary_parts). A string is looked at once, and what is found is marked in the text, so the work grows with the text and its candidates."""
    words = list(SENSITIVE.finditer(text))
    if not words:
        return []
    full = [m.span() for m in CANDIDATE.finditer(text)]
    begins, ends = [s for s, _ in full], [e for _, e in full]
    out: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    taken = bytearray(len(text))
    for start, _, end in base:
        taken[start:end] = b"\1" * (end - start)
    for word in words:
        for s, e in full[bisect_left(ends, word.start() - near) : bisect_right(begins, word.end() + near)]:
            for start, end in [(s, e)] if e <= word.start() or s >= word.end() else [(s, word.start()), (word.end(), e)]:
                if end - start < LEAST or (start, end) in seen:
                    continue
                seen.add((start, end))
                found = text[start:end].rstrip(".=!")
                if not found or 1 in taken[start:end]:
                    continue
                if novelty(found, text[max(0, start - around) : start] + text[end : end + around], ordinary) >= least * len(found):
                    out.append((start, 3, start + len(found)))
                    taken[start : start + len(found)] = b"\1" * len(found)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex long, base_sha256, spans, n_novel long: a row for each row of docs.

    Spans count code points, the end exclusive, and are sorted by start and then kind. Whole texts are searched; a null
    text counts as empty and has no spans; repeated rows get equal results; an empty table gives none. What the corpus's documents have in
    common is no secret: their commonest parts of words are the compressor's dictionary, beside fixed ones (see ordinary_parts).
    """
    ordinary = ordinary_parts(docs, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            base = [base_spans(t or "") for t in pdf["text"]]
            new = [novel_spans(t or "", b, ordinary=ordinary) for t, b in zip(pdf["text"], base, strict=True)]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["id"],
                    **{f"n_{kind}": [sum(s[1] == k for s in b) for b in base] for k, kind in enumerate(KINDS[:3])},
                    "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                    "spans": [joined(b + x) for b, x in zip(base, new, strict=True)],
                    "n_novel": [len(x) for x in new],
                }
            )

    return modest(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    )
