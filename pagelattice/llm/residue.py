"""Problem 4: fields that hold what a template, a draft, a failing server or a script check left there.

**Repeated whole-page templates.** Every sentence (of a title: every part) becomes a template whose hosts, paths and numbers are slots. Nothing about its wording decides; what does is
how it is repeated. What a template, a draft or a failing server leaves behind turns up on unrelated pages: a template of a summary or excerpt is residue where at least ``sites`` sites have it,
about as many as if its pages were drawn from all pages regardless of their site (``spread``; copies of an article stay on few), where it mostly makes up the whole field together with other such templates
(``whole``; a consent banner or a menu stands in front of content), and where its pages have different titles (``variety``; copies of an article share theirs). Where titles can't tell, it must name
a host or path and make up nearly every field, or lie on pages whose title is residue. A template of a title is residue where it is a residue sentence, or where it is as independent of the site
and enough of its pages (``beside``) have a summary or excerpt that is residue; a title that only speaks of errors has ordinary text beside it.

**Slots.** Sentences made from one template share their words but for the slots. A token of a suspicious kind (a variable name in the delimiters of a template language, or a
default such as null, NaN or [object Object]) is aligned with all other sentences of the corpus that have the same two words on one side and the same word on the other:
these are fillings of the same place, one word or several. Where many different sites keep that very token there, and few have anything else, it is part of what the text says (a
tutorial about ``${HOME}``, an article on null readings); where the others have ordinary words, or one site alone prints it, the place is a slot and the token was left in it. A slot left blank is a text that has
the words on both sides of a known slot (one left at several sites) next to each other, or with a blank before a comma or stop or empty brackets or quotes between them, where other sites have several different words there.

**What is too rare to be compared** (sentences on fewer than ``sites`` sites, as in small tables) is judged by its wording: the reason phrases of HTTP, requests to turn scripts on, marks of drafts. Latin filler
counts by its vocabulary.

The texts are split and hashed by built-in expressions; Python reads only fields with a suspicious sign (first) and, for the fillings, all texts once. The wanted contexts are broadcast as two bitmaps of
fixed size and joined exactly afterwards, so the same plan serves every size. Variable names may have any length; up to six further words, filters or indexes of 40 characters each belong to a placeholder.

Defined cases: null and empty fields are no cases; rows with error 'unsupported_url' are left out; null ids take no part; repeated rows give one row per id and field;
whole texts are read; an empty table gives an empty result; further columns are ignored; rows without a domain are one site, and in a table without that column every different text is one.
"""

from __future__ import annotations

import re
import zlib
from http import HTTPStatus
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix64

FIELDS = ("title", "summary", "text_excerpt")

_NAME = r"[A-Za-z_][\w.\-]*"
# What a template language allows besides a bare name: several words, filters and their arguments, indexes.
_WIDE = _NAME + r"(?:\[[\w'\"]{1,30}\]|[ ]?\|[ ]?[\w:.'\"(), -]{1,40}|[ ][\w.\-]{1,30}){0,6}"
_FORM = r"(?:your|insert|enter|add|type|choose|customer|client|company|business|first|last|full|user|recipient|product|name|date|city|street|phone|email|e-mail)"
# In single square or angle brackets, which ordinary text uses too, several words count where one of the first two asks for a value.
_ASKED = r"(?i:(?:[a-z][\w'-]{0,30}[ ])?" + _FORM + r"(?:[ ][\w'-]{1,30}){1,5}|[a-z][\w'-]{0,30}[ ]" + _FORM + r")"
PLACEHOLDER = re.compile(
    "|".join(
        [
            r"\{\{\{?\s*" + _WIDE + r"\s*\}?\}\}", r"[$#]\{\s*" + _WIDE + r"\s*\}", r"%%\s*" + _WIDE + r"\s*%%", r"\[\[\s*" + _WIDE + r"\s*\]\]", r"\[" + _ASKED + r"\](?!\()", r"<" + _ASKED + r">",
            r"\{\{\{?\s*" + _NAME + r"\s*\}?\}\}", r"[$#]\{\s*" + _NAME + r"\s*\}", r"\{%-?\s*" + _NAME + r"[^%{}]*%\}", r"<[%?]=?\s*" + _NAME + r"\s*[%?]>",
            r"%%\s*" + _NAME + r"\s*%%", r"@@\s*" + _NAME + r"\s*@@", r"%\(" + _NAME + r"\)[sdSD]", r"\*\|" + _NAME + r"\|\*", r"\[%-?\s*" + _NAME + r"[^%\[\]]*%\]",
            r"\[\[\s*" + _NAME + r"\s*\]\]", r"\[" + _NAME + r"\]", r"\{" + _NAME + r"\}", r"(?<!\w)__[A-Za-z](?:[\w.]*?[A-Za-z\d])?__(?!\w)", r"\$" + _NAME + r"\$",
            r"&[lL][tT];" + _NAME + r"&[gG][tT];", r"<" + _NAME + r">", r"\{\d\}", r"(?<![\w%])%[sdSD](?!\w)",
            # halves, where the rest was cut off
            r"(?:\{\{|[$#]\{|\{%|<[%?]=?|%%|@@|\*\||\[%|\[\[|%\()\s*[\w.]*\s*$", r"(?<!\S)[\w.]*\s?(?:\}\}|%\}|[%?]>|%\]|\]\]|\|\*)(?!\w)",
        ]
    )
)
DEFAULT = re.compile(r"\(null\)|\[object object\]|\barray\(\)|#ref!|(?<![\w.-])(?:null|undefined)(?![\w-])", re.I)
# Words that are ordinary ones in other cases: they count as written, or in a text that is all upper or all lower case.
CASED_DEFAULT = re.compile(r"(?<![\w.'-])(?:None|NaN)(?![\w'-])")
CASED_ANY = re.compile(CASED_DEFAULT.pattern, re.I)
# A slot left blank leaves a blank before a comma or stop, or empty brackets or quotes. Two blanks are no trace: whole sentences are spaced so.
BLANK = re.compile(r"(?<=\w) (?=[,.](?:\s|$))|\( *\)|\" *\"|“ *”")

# The vocabulary of the usual Latin filler.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi "
    "aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_LATIN_SHORT = {w for w in LATIN if len(w) <= 3}
_WORDS = re.compile(r"[^\W\d_]+")
_LATIN_RARE = "lorem ipsum dolor amet consectetur adipiscing cupidatat occaecat voluptate nostrud ullamco laboris veniam aliqua proident deserunt mollit tempor eiusmod".split()
_QUICK = re.compile(r"[{}\[\]<>%@$*#_]|&lt;|&LT;|null|undefined|none|nan\b|array", re.I)

# Wording of whole sentences too rare to be compared, in their normal form (lower case, one blank between words, numbers as 9). Reason phrases as HTTP defines them, and what stands for them elsewhere.
_REASONS = [re.sub(r"\W+", " ", s.phrase.lower()).replace("timeout", "time ?out") for s in HTTPStatus if s >= 400]
_SAID = ["page not found", "access denied", "zugriff verweigert", "seite nicht gefunden", "page introuvable", "acc[eè]s refus[eé]", "p[aá]gina no encontrada", "acceso denegado", "session expired", "connection timed out", "just a moment", "loading", "untitled error", "javascript required"]
_STATUS = "(?:error 9|(?:(?:error |http )?9 )?(?:" + "|".join(_REASONS + _SAID) + "))"
WORDING = (
    "^(?:"
    + "|".join(
        [
            _STATUS + "(?: HOST)?",
            "(?:please |you (?:need|have) to )?(?:enable|activate|turn on|allow) (?:javascript|scripts?|scripting)(?: .*)?", "(?:javascript|scripts?|scripting) (?:is|are) (?:disabled|required|switched off|turned off).*",
            "(?:bitte )?aktivieren sie (?:javascript|skripte).*", "(?:veuillez )?activ(?:ez|er) (?:javascript|les scripts).*", "(?:por favor )?activ[ea] (?:javascript|los scripts).*",
            "(?:please )?(?:verify|confirm|verifying)(?: that)? you are (?:a )?human.*", "checking your browser.*",
            "uncaught (?:exception|error) .*", "traceback most recent call last.*", "(?:fatal error|warning|parse error|notice) .* on line 9",
            "database (?:connection )?(?:error|failed)", "this site can t be reached(?: HOST)?", "(?:oops )?something (?:broke|went wrong)",
            "todo [^ ]+(?: [^ ]+){0,7}", "this is a placeholder.*", "(?:add|insert|write|replace|describe) .* (?:here|with your own words)", "(?:your|insert|add|enter|example|sample|placeholder|dummy) (?:[^ ]+ )?(?:text|title|headline|tagline|content|copy|heading)(?: [^ ]+)?(?: goes)?(?: here)?",
        ]
    )
    + ")$"
)
_HOST = r"[a-z0-9_-]+(?:\.[a-z0-9_-]+)*\.[a-z]{2,}"
_CODE = r"^\W*(?i:error |http )?[45]\d\d(?:\W+(?i:" + _HOST + r"))?\W*$"

SENTENCE = r"(?<=[.!?])\s+|\n+|\s\|\s"
# What separates words: white space, punctuation and signs, listed because classes by script are slow.
_BETWEEN = r"[\s\x00-/:-@\[-`{-~\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf×÷\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3020\uff00-\uff0f\uff1a-\uff20]+"
TAIL = 3
KINDS = "<>="
TITLE_PART = r"\n+|\s[-|–—:·]{1,2}\s|(?<=[.!?])\s+"


def has_sign(text: Column) -> Column:
    """Whether a text may hold a placeholder, a default, a visible blank or Latin filler; says yes too often, never too rarely."""
    def held(low: Column) -> Column:
        found = low.rlike(r"[{}\[\]<>%@$*#_]|\( *\)|\" *\"|“ *”")
        for word in ("null", "undefined", "none", "nan", "array(", "&lt;", " ,", " .", *_LATIN_RARE):
            found = found | low.contains(word)
        return found

    return F.exists(F.array(F.lower(text)), held)  # so that the text is lowered once


def has_filler(text: str, run: int = 4) -> bool:
    """Whether ``run`` words in a row are Latin filler, three of them longer than a syllable."""
    streak = long = 0
    for w in _WORDS.findall(text.lower()):
        if w in LATIN:
            streak += 1
            long += w not in _LATIN_SHORT
            if streak >= run and long >= 3:
                return True
        else:
            streak = long = 0
    return False


_NORMAL = {c: " " for c in range(0x80) if not chr(c).isalnum()} | {ord(d): "9" for d in "0123456789"}
_NORMAL |= {ord(c): " " for c in "…–—“”„‘’«»· ​"}


def normal_words(text: str) -> list[str]:
    return text.lower().translate(_NORMAL).split()


def blank_places(text: str) -> list[tuple[str, str]]:
    """(token, context) of every place that looks like a blank slot and has two words on both sides."""
    out = []
    for m in BLANK.finditer(text):
        before, after = normal_words(text[max(0, m.start() - 120) : m.start()])[-2:], normal_words(text[m.end() : m.end() + 120])[:2]
        if len(before) == 2 and len(after) == 2:
            out.append(("", "=" + " ".join(before + after)))
    return out


def suspicious_places(text: str) -> list[tuple[str, list[str], list[str]]]:
    """(token, two words before, two words after) of every variable name and default in a text."""
    if not _QUICK.search(text):
        return []
    uniform = text.upper() == text or text.lower() == text
    spans = [m.span() for m in PLACEHOLDER.finditer(text)]
    for pattern in (DEFAULT, CASED_ANY if uniform else CASED_DEFAULT):
        spans += [m.span() for m in pattern.finditer(text) if not any(a <= m.start() < b for a, b in spans)]
    out = []
    for a, b in spans:
        if a < b and text[a:b].strip():
            out.append((text[a:b].strip().lower(), _words_before(text, a), _words_after(text, b)))
    return out


def _words_before(text: str, at: int) -> list[str]:
    """The two words before a place, however long they are."""
    size = 64
    while True:
        words = normal_words(text[max(0, at - size) : at])
        if len(words) > 2 or size >= at:
            return words[-2:]
        size *= 4


def _words_after(text: str, at: int) -> list[str]:
    size = 64
    while True:
        words = normal_words(text[at : at + size])
        if len(words) > 2 or at + size >= len(text):
            return words[:2]
        size *= 4


def contexts(before: list[str], after: list[str]) -> list[str]:
    """The contexts of a place: two words on one side and one on the other, and two on both; a place at an end of a text has fewer."""
    found = []
    if len(before) >= 2 and after:
        found.append(f"<{before[-2]} {before[-1]} {after[0]}")
    if before and len(after) >= 2:
        found.append(f">{before[-1]} {after[0]} {after[1]}")
    if len(before) >= 2 and len(after) >= 2:
        found.append("=" + " ".join(before[-2:] + after[:2]))
    return found


def _first_pass(batches):
    """Suspicious places of fields with a suspicious sign: a place with its contexts, 'b...' for a visible blank, no place for filler."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        rows: list[tuple] = []
        for tab, site, field, text in zip(*(batch.column(c).to_pylist() for c in ("id", "site", "field", "text"))):
            if has_filler(text):
                rows.append((tab, site, field, None, None))
                continue
            for place, (token, before, after) in enumerate(suspicious_places(text)):
                rows.extend((tab, site, field, f"{place} {token}", key) for key in contexts(before, after) or [""])
            for place, (token, key) in enumerate(blank_places(text)):
                rows.append((tab, site, field, f"b{place} {token}", key))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["tab_id", "site", "field", "place", "context"])


class _Codes(dict):
    """Words to 32-bit codes, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return code


def _cell(kind: int, first: np.ndarray, second: np.ndarray, other: np.ndarray | None, bits: int) -> np.ndarray:
    """Cells of pairs of words on the longer side of a context of some kind, or with the other side's code those of whole contexts."""
    x = mix64((first << np.uint64(32)) | second)
    with np.errstate(over="ignore"):
        return (mix64(x + np.uint64(kind) if other is None else x + mix64(other) + np.uint64(kind + 7)) % np.uint64(bits)).astype(np.int64)


def _cells(bits: int):
    """Cells of contexts: of the pair on the longer side (whole 0) and of all of it (whole 1)."""

    def run(batches):
        codes = _Codes()
        for batch in batches:
            for kind in range(3):
                words = [k[1:].split(" ") for k in batch.column("context").to_pylist() if k[0] == KINDS[kind]]
                if words:
                    first, second = (np.array([codes[w[i + (kind == 1)]] for w in words], np.uint64) for i in (0, 1))
                    other = np.array([codes[w[0]] if kind == 1 else codes[w[2]] for w in words], np.uint64)
                    if kind == 2:
                        other = (other << np.uint64(32)) | np.array([codes[w[3]] for w in words], np.uint64)
                    for whole, cell in enumerate((_cell(kind, first, second, None, bits), _cell(kind, first, second, other, bits))):
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(cell)), pa.array(np.full(len(np.unique(cell)), whole, np.int32))], names=["cell", "whole"])

    return run


def wanted_bitmaps(wanted: DataFrame, bits: int) -> list[bytes]:
    """Bitmaps of fixed size over the wanted contexts' longer sides and over the whole contexts: at most ``bits`` cells of each reach the driver."""
    got = wanted.select("context").mapInArrow(_cells(bits), "cell long, whole int").distinct().toArrow()
    on = np.zeros((2, bits), np.uint8)
    on[got.column("whole").to_numpy(), got.column("cell").to_numpy()] = 1
    return [np.packbits(x).tobytes() for x in on]


def fillings(words: list[list[str]], longest: int, codes: _Codes, maps=None, bits: int = 0):
    """(text, context, filling) of at most ``longest`` words between the sides of a context (none between two and two words: a blank) in any of the texts, the nearest other side first.

    ``maps`` are the bitmaps of the contexts to look for, all without them. A context is two words in a row and on the other side one ('<' behind, '>' before) or two ('=' behind)."""
    flat = list(chain.from_iterable(words))
    if len(flat) < 2:
        return
    sizes = np.array([len(w) for w in words])
    end, start = np.cumsum(sizes), np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(words)), sizes)
    code = np.fromiter(map(codes.__getitem__, flat), np.uint64)
    double = np.append((code[:-1] << np.uint64(32)) | code[1:], np.uint64(0))
    paired = np.flatnonzero(row[:-1] == row[1:])
    for kind in range(3):
        i = paired if maps is None else paired[maps[0][_cell(kind, code[paired], code[paired + 1], None, bits)] > 0]
        met: list[np.ndarray] = []
        for gap in range(0 if kind == 2 else 1, longest + 1):
            at = i - gap - 1 if kind == 1 else i + 2 + gap
            ok = at >= start[row[i]] if kind == 1 else at + (kind == 2) < end[row[i]]
            p, q = i[ok], at[ok]
            other = double[q] if kind == 2 else code[q]
            if maps is not None:
                hit = maps[1][_cell(kind, code[p], code[p + 1], other, bits)] > 0
                p, q, other = p[hit], q[hit], other[hit]
            met.append(np.stack([p, q, other.view(np.int64)], axis=1))
        found = np.concatenate(met)
        # Of equal other sides the nearest counts; gaps come in ascending order.
        _, nearest = np.unique(found[:, [0, 2]], axis=0, return_index=True)
        for p, q in found[nearest, :2].tolist():
            other = f"{flat[q]} {flat[q + 1]}" if kind == 2 else flat[q]
            key = f">{other} {flat[p]} {flat[p + 1]}" if kind == 1 else f"{KINDS[kind]}{flat[p]} {flat[p + 1]} {other}"
            yield int(row[p]), key, " ".join(flat[q + 1 : p] if kind == 1 else flat[p + 2 : q])


def _count_contexts(held, longest: int, bits: int):
    """Every filling of the wanted contexts (all contexts without bitmaps) once per site and batch; blanks with their field."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        codes, maps = _Codes(), None if held is None else [np.unpackbits(np.frombuffer(x, np.uint8)) for x in held.value]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                words = [normal_words(t) for t in batch.column("text").to_pylist()]
                tabs, sites, fields = (batch.column(c).to_pylist() for c in ("id", "site", "field"))
                found = {(key, filling, sites[r], None, None) if filling else (key, filling, sites[r], tabs[r], fields[r]) for r, key, filling in fillings(words, longest, codes, maps, bits)}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["context", "filling", "site", "tab_id", "field"])

    return run


def normal_parts(text: Column, by: str) -> Column:
    """The sentences (or parts) of a text in normal form: lower case, hosts, paths and numbers as slots, one blank between words."""
    def slotted(low: Column) -> Column:
        s = F.when(low.rlike(r"\.[a-z]"), F.regexp_replace(low, r"\b(?:[a-z0-9_-]+\.)+[a-z]{2,}\b", " HOST ")).otherwise(low)
        s = F.when(s.contains("/"), F.regexp_replace(s, r"(?<![\w<])/[\p{L}\p{N}_./%-]*[\p{L}\p{N}_/%-]", " PATH ")).otherwise(s)
        return F.regexp_replace(s, r"[a-z]?\d[\p{L}\p{N}_#]*", "9")

    whole = F.transform(F.array(F.lower(text)), slotted)
    return F.transform(F.split(whole[0], by), lambda x: F.trim(F.regexp_replace(x, _BETWEEN, " ")))


def title_key(title: Column) -> Column:
    """A hash of the two longest words of a title, null without any: copies of a page share it, whatever stands around their titles."""
    words = F.filter(F.array_distinct(F.split(F.lower(title), _BETWEEN)), lambda w: w != "")
    longest = F.slice(F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 2)
    return F.transform(F.array(longest), lambda x: F.when(F.size(x) > 0, F.xxhash64(x)))[0]


def sentences(texts: DataFrame, least_words: int) -> DataFrame:
    """(tab_id, field, site, titled, template, tail, slotted, worded, pieces): every different sentence of a field (of a title: every part), once; pieces is their number."""
    is_title, text = F.col("field") == "title", F.col("text")
    code = text.rlike(_CODE)
    parts = F.when(code, F.array(F.lit("HTTP CODE"))).when(is_title, normal_parts(text, TITLE_PART)).otherwise(normal_parts(text, SENTENCE))
    letters = lambda t: t.rlike(r"\p{L}")
    enough = lambda t: F.size(F.split(t, " ")) >= least_words
    kept = F.array_distinct(F.filter(parts, lambda t: F.when(is_title, t != "").otherwise(letters(t) & (enough(t) | t.rlike(WORDING)))))
    # explode would add a filter on the arrays that makes them a second and third time; explode_outer doesn't.
    rows = texts.select(F.col("id").alias("tab_id"), "field", "site", "titled", code.alias("code"), kept.alias("parts"))
    rows = rows.select("tab_id", "field", "site", "titled", "code", F.size("parts").alias("pieces"), F.explode_outer("parts").alias("t")).where("t is not null")
    slotted = F.col("t").contains("HOST") | F.col("t").contains("PATH")
    last = F.split("t", " ")
    tail = F.when(F.size(last) >= TAIL, F.xxhash64(F.slice(last, F.size(last) - (TAIL - 1), F.lit(TAIL))))
    return rows.select("tab_id", "field", "site", "titled", F.xxhash64("t").alias("template"), tail.alias("tail"), slotted.alias("slotted"), (F.col("code") | F.col("t").rlike(WORDING)).alias("worded"), "pieces")


def expected_sites(texts: DataFrame, n: Column) -> Column:
    """How many different sites n pages would lie on if they were drawn regardless of their site; site sizes come as a histogram of at most some hundred rows."""
    sizes = texts.groupBy("site").agg(F.count_distinct("id").alias("c")).groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.count("*").alias("sites"), F.avg("c").alias("c")).collect()
    pages = max(1.0, sum(r.sites * r.c for r in sizes))
    terms = [F.lit(float(r.sites)) * (1 - F.exp(n * F.lit(float(np.log1p(-min(r.c / pages, 1 - 1e-12)))))) for r in sorted(sizes, key=lambda r: r.b)]
    return sum(terms, F.lit(0.0))


def repeated_templates(texts: DataFrame, sites: int = 5, spread: float = 0.6, whole: float = 0.5, variety: float = 0.65, beside: float = 0.2, whole_slotted: float = 0.9, by_title: float = 0.5, least_words: int = 2) -> DataFrame:
    """(tab_id, field) of fields with a sentence that is residue by its repetition, or by its wording where it is too rare to be compared."""
    rows = checkpoint(sentences(texts, least_words))  # hashes only, read several times
    often = rows.select("template", (F.col("field") == "title").alias("of_title"), "site").distinct().groupBy("template", "of_title").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= sites)
    of_title = F.col("field") == "title"
    held = rows.withColumn("of_title", of_title).join(often, ["template", "of_title"], "left").where(F.col("n_sites").isNotNull() | F.col("worded"))
    held = checkpoint(held.distinct())
    rare = held.where("n_sites is null").select("tab_id", "field").distinct()
    held = held.where("n_sites is not null")
    full = held.groupBy("tab_id", "field").agg((F.count("*") == F.max("pieces")).cast("int").alias("full"))
    judged = held.join(full, ["tab_id", "field"])
    # Titles that are residue by wording count as known beside a body.
    title_known = held.where("of_title and worded").select("tab_id").unionByName(rare.where("field = 'title'").select("tab_id")).distinct().withColumn("known", F.lit(1))
    per = judged.where("not of_title").join(title_known, "tab_id", "left").groupBy("template").agg(
        F.count("*").alias("n"), F.max("n_sites").alias("n_sites"), F.avg("full").alias("full"), F.count_distinct("titled").alias("titles"), F.max("slotted").alias("slotted"), F.max("worded").alias("worded"), F.max("tail").alias("tail"), F.avg(F.coalesce("known", F.lit(0))).alias("known"),
    )
    independent = F.col("n_sites") >= spread * expected_sites(texts, F.col("n"))
    own = (F.col("full") >= whole) & (F.col("titles") >= variety * F.col("n"))
    by_words = F.col("worded") & (F.col("full") >= whole)
    kept = checkpoint(per.where(by_words | (independent & (own | (F.col("slotted") & (F.col("full") >= whole_slotted)) | (F.col("known") >= by_title)))).select("template", "tail"))
    # Put into the middle of other text, a sentence is found by its last words, where most sentences that end so are such a template.
    ends = rows.join(kept.where("tail is not null").select("tail").distinct(), "tail", "left_semi").select("tab_id", "field", "tail", "template")
    ends = ends.join(kept.select("template", F.lit(1).alias("whole")), "template", "left")
    tails = ends.groupBy("tail").agg(F.avg(F.coalesce("whole", F.lit(0))).alias("share")).where(F.col("share") >= whole).select("tail")
    bodies = held.where("not of_title").join(kept, "template", "left_semi").select("tab_id", "field")
    bodies = checkpoint(bodies.unionByName(ends.where(~of_title).join(tails, "tail", "left_semi").select("tab_id", "field")).distinct())
    bad = bodies.select("tab_id").distinct().withColumn("bad", F.lit(1))
    parts = held.where("of_title").join(bad, "tab_id", "left").groupBy("template").agg(F.count("*").alias("n"), F.max("n_sites").alias("n_sites"), F.sum(F.coalesce("bad", F.lit(0))).alias("beside"))
    beside_bad = parts.where(independent & (F.col("beside") >= 3) & (F.col("beside") >= beside * F.col("n"))).select("template")
    titles = rows.where(of_title).join(beside_bad.unionByName(kept.select("template")).distinct(), "template", "left_semi").select("tab_id", "field")
    # A title whose wording says so counts unless its parts were compared and have ordinary text beside them throughout.
    cleared = parts.where(independent & (F.col("n") >= 4 * sites) & (F.col("beside") == 0)).select("template")
    worded = held.where("of_title and worded").join(cleared, "template", "left_anti").select("tab_id", "field")
    return rare.unionByName(bodies).unionByName(titles).unionByName(worded).distinct()


def residue_fields(tabs: DataFrame, share: float = 0.5, support: int = 3, broadcast_contexts: int = 1 << 22, longest: int = 6, hidden_share: float = 0.05) -> DataFrame:
    """(tab_id, field) of every field that holds residue.

    Witnesses are sites (``domain``; rows without one are one site), or different texts where the table has no such column, so that a template which one site prints on
    many rows counts once. A context says a token where ``support`` witnesses have it there and make up ``share`` of all pairs of a witness and a filling of up to ``longest``
    words. A place is said where a context says so and no other context of it has so many pairs and the token in a smaller share of them. ``broadcast_contexts`` is the size of the bitmaps
    in bits; without them (0) the contexts of all texts are made and joined, with the same counts."""
    rows = tabs.where("id is not null and (error is null or error <> 'unsupported_url')")
    by_field = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in FIELDS])
    site = F.xxhash64(F.coalesce(F.col("domain").cast("string"), F.lit(""))) if "domain" in tabs.columns else F.xxhash64("f.text")
    texts = rows.select(F.col("id").cast("long").alias("id"), title_key(F.col("title").cast("string")).alias("titled"), *(["domain"] if "domain" in tabs.columns else []), F.explode(by_field).alias("f"))
    texts = texts.where("f.text <> ''").select("id", site.alias("site"), "titled", "f.field", "f.text")
    read = texts.select("id", "site", "field", "text")
    places = checkpoint(read.where(has_sign(F.col("text"))).mapInArrow(_first_pass, "tab_id long, site long, field string, place string, context string"))
    visible = places.where("place like 'b%'")
    slots = places.where("place not like 'b%' and context <> ''").withColumn("token", F.expr("substring(place, instr(place, ' ') + 1)"))
    one_sided = slots.where("context not like '=%'")
    spot = ["tab_id", "field", "place"]
    own = checkpoint(one_sided.groupBy("context", "token").agg(F.count_distinct("site").alias("own")))
    asked = checkpoint(one_sided.join(one_sided.join(own.where(F.col("own") >= support), ["context", "token"], "left_semi").select(*spot).distinct(), spot, "left_semi").select(*spot, "context", "token"))
    wanted = checkpoint(asked.select("context").unionByName(visible.select("context")).unionByName(slots.where("context like '=%'").select("context")).distinct())
    held = places.sparkSession.sparkContext.broadcast(wanted_bitmaps(wanted, broadcast_contexts)) if broadcast_contexts else None
    counted = read.mapInArrow(_count_contexts(held, longest, broadcast_contexts), "context string, filling string, site long, tab_id long, field string").distinct().join(wanted, "context", "left_semi")
    counted = checkpoint(counted)  # read several times
    filled_in = counted.where("filling <> ''")
    pairs = filled_in.groupBy("context").agg(F.count("*").alias("pairs"))
    judged = asked.join(own, ["context", "token"]).join(pairs, "context", "left").withColumn("pairs", F.greatest(F.coalesce("pairs", F.lit(0)), F.col("own")))
    most = F.col("own") >= share * F.col("pairs")
    votes = judged.groupBy(*spot).agg(F.max((most & (F.col("own") >= support)).cast("int")).alias("yes"), F.max((~most & (F.col("pairs") >= support)).cast("int")).alias("no"))
    said = votes.where("yes = 1 and no = 0").select(*spot)
    left = places.where("place not like 'b%'").select(*spot).distinct().join(said, spot, "left_anti")
    # A blank is residue where others have words: several fillings at several sites, and the blank at fewer. Two words that simply stand next to each other must be rare there, since many words can be left out.
    known = slots.where("context like '=%'").join(left, spot, "left_semi").groupBy("context").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= support).select("context")
    blank = visible.select("tab_id", "site", "field", "context", F.lit(share).alias("most"))
    blank = blank.unionByName(counted.where("filling = ''").join(known, "context", "left_semi").select("tab_id", "site", "field", "context", F.lit(hidden_share).alias("most")))
    empty = blank.groupBy("context", "most").agg(F.count_distinct("site").alias("own"))
    filled = filled_in.groupBy("context").agg(F.count_distinct("filling").alias("kinds"), F.count_distinct("site").alias("sites"), F.count("*").alias("pairs"))
    slot = filled.join(empty, "context").where((F.col("kinds") >= support) & (F.col("sites") >= support) & (F.col("own") < F.col("most") * (F.col("pairs") + F.col("own")))).select("context", "most")
    left = left.select("tab_id", "field").unionByName(blank.join(slot, ["context", "most"], "left_semi").select("tab_id", "field"))
    filler = places.where("place is null").select("tab_id", "field")
    return filler.unionByName(repeated_templates(texts)).unionByName(left).distinct()
