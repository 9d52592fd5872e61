"""Text functions, Column to Column; ``compose`` takes a table."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words that carry no content, folded.
STOPWORDS = [
    "ai", "anh", "ban", "bang", "bi", "biet", "cac", "cach", "can", "chi", "cho", "chu", "chung", "co", "con", "cua", "cung", "da", "dang", "day",
    "de", "den", "di", "do", "duoc", "gi", "hay", "hien", "hon", "khi", "khong", "la", "lai", "lam", "len", "luc", "ma", "minh", "mot", "muon", "nao",
    "nay", "neu", "ngay", "nguoi", "nhieu", "nhung", "noi", "o", "qua", "ra", "rat", "roi", "sau", "se", "su", "tai", "tat", "the", "theo", "thi",
    "thoi", "trong", "truoc", "tu", "tung", "va", "van", "ve", "vi", "voi", "vua",
]

# Phrases of greetings and channel promotion, folded.
BOILERPLATE = [
    "cam on cac ban da theo doi", "hen gap lai", "hay subscribe", "khong bo lo nhung video", "dang ky kenh", "subscribe kenh",
    "fanpage", "youtube channel", "ban quyen", "theo doi thong tin tai", "chuong trinh duoc tai tro", "cong ty ajinomoto viet nam",
    "xin chao tat ca cac ban", "chao mung quy vi den voi chuong trinh", "rat han hanh duoc gap lai",
]

# Scene labels and their cues.
SCENE_CUES = {
    "indoor": ["trong nhà", "phòng", "bệnh viện", "văn phòng", "studio"],
    "outdoor": ["ngoài trời", "đường phố", "cánh đồng", "bờ sông", "biển", "công viên"],
    "night": ["ban đêm", "ban tối", "trời tối"],
    "daytime": ["ban ngày", "buổi sáng", "buổi trưa", "trời sáng"],
    "rain": ["trời mưa", "đang mưa", "mưa lớn"],
    "sunny": ["trời nắng", "ánh nắng", "trời sáng"],
}


# Words that speech recognition often gets wrong, and what was said.
ASR_FIXES = [
    (r"\bsông Cổ Long\b", "sông Cửu Long"), (r"\bsông Củ Long\b", "sông Cửu Long"), (r"\bsụt lúng\b", "sụt lún"), (r"\bsạt lỡ\b", "sạt lở"), (r"\bnước biển dân\b", "nước biển dâng"),
    (r"\bthiên tài\b", "thiên tai"), (r"\bxã lũ\b", "xả lũ"), (r"\bmạnh thần quân\b", "mạnh thường quân"), (r"\bthiên nguyện\b", "thiện nguyện"), (r"\bđầy ấp\b", "đầy ắp"),
    (r"\btrạng đua\b", "chặng đua"), (r"\bbà đồng viên\b", "vận động viên"), (r"\btân tốc\b", "tăng tốc"), (r"\bthết đải\b", "thiết đãi"), (r"\btiêu say\b", "tiêu xay"),
]


def _fold_map() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition; d with stroke besides."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha() and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_map()


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _composable() -> str:
    """A class of the characters without which a text is composed already: marks, Hangul letters, and those that composition
    replaces by others."""
    codes = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return r"[\p{M}\u1100-\u11FF" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


COMPOSABLE = _composable()


#: Texts that are composed at a time.
COMPOSED_ROWS = 256


def compose(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` in composed form (NFC) and single spaces, as ``normalize_text``. Only texts that hold a
    character which composition may touch go through Arrow; a regular expression on the JVM tells them. COMPOSED_ROWS of a
    batch are Python's strings at a time, and go on before the next are read. Nulls stay."""
    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for start in range(0, batch.num_rows, COMPOSED_ROWS):
                part = batch.slice(start, COMPOSED_ROWS)
                texts = pa.array([unicodedata.normalize("NFC", t.as_py()) for t in part.column(at)], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(part.columns)], schema=batch.schema)

    touched = F.coalesce(F.col(column).rlike(COMPOSABLE), F.lit(False))
    both = rows.where(~touched).unionByName(rows.where(touched).mapInArrow(composed, rows.schema))
    return both.withColumn(column, normalize_text(F.col(column)))


def tokenize(c: Column) -> Column:
    """Word runs, case-folded."""
    return F.regexp_extract_all(F.lower(F.replace(c, F.lit("ß"), F.lit("ss"))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def query_terms(c: Column) -> Column:
    """Distinct word runs without underscores, case-folded."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.replace(c, F.lit("ß"), F.lit("ss"))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def ascii_fold(c: Column) -> Column:
    """Accents off. A text of as many bytes as characters has none."""
    return F.when(F.octet_length(c) != F.length(c), F.translate(c, FOLD_FROM, FOLD_TO)).otherwise(c)


def fold_key(c: Column) -> Column:
    """Accents off, lower case, anything but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", " "))


def content_tokens(c: Column) -> Column:
    words = F.split(fold_key(c), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def is_boilerplate(c: Column) -> Column:
    return fold_key(c).rlike("|".join(BOILERPLATE))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - similarity; 0 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0.0)).otherwise(1 - jaccard(a, b))


def scene_labels(c: Column) -> Column:
    """Labels whose cues the text holds. It is cleaned once for all cues: it is bound to a lambda's variable."""
    def found(text):
        return F.array_compact(F.array(*[F.when(F.greatest(*[text.contains(cue).cast("int") for cue in cues], F.lit(0)) == 1, F.lit(label)) for label, cues in SCENE_CUES.items()]))

    return F.element_at(F.transform(F.array(F.lower(normalize_text(c))), found), 1)


def phrase_ngrams(tokens: Column) -> Column:
    """Word pairs and triples of a token array, joined by spaces."""
    n = F.size(tokens)
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.zip_with(pairs, F.slice(tokens, F.lit(3), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(F.concat(pairs, triples))


def join_distinct(texts: Column, limit: int, sep: str = " ") -> Column:
    """Texts in order, blank ones and those of equal folded case left out, at most ``limit``, joined. Each text is cleaned
    and folded once: the arrays are bound to a lambda's variable."""
    clean = F.filter(F.transform(texts, normalize_text), lambda t: t.isNotNull() & (t != ""))
    folded = F.transform(F.array(clean), lambda c: F.struct(c.alias("said"), F.transform(c, F.lower).alias("key")))
    first = F.transform(folded, lambda f: F.transform(F.slice(F.array_distinct(f["key"]), 1, limit), lambda k: F.element_at(f["said"], F.array_position(f["key"], k).cast("int"))))
    return F.array_join(F.element_at(first, 1), sep)


def truncate_words(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word border with an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, limit - 1), r"\s+\S*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(cut, r"[\s,;:.\-]+$", ""), F.lit("…")))


def sentence(c: Column) -> Column:
    """First letter upper-cased, a final stop added."""
    first = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
    return F.when(F.length(c) == 0, c).when(c.rlike(r"[.!?…]$"), first).otherwise(F.concat(first, F.lit(".")))


def evidence_caption(ocr: Column, speech: Column, objects: Column, scenes: Column) -> Column:
    """Caption from what was seen, read and heard."""
    return F.concat_ws(" ", F.when(F.size(objects) > 0, F.concat(F.lit("có "), F.array_join(F.slice(objects, 1, 8), ", "))),
                       F.when(F.size(scenes) > 0, F.concat(F.lit("bối cảnh "), F.array_join(scenes, ", "))),
                       F.when(ocr != "", F.concat(F.lit("chữ nhìn thấy: "), F.substring(ocr, 1, 240))),
                       F.when(speech != "", F.concat(F.lit("lời thoại: "), F.substring(speech, 1, 240))))


def clean_text(c: Column, most: int = 320) -> Column:
    """A spoken line as a sentence: white space and dashes at the ends off, recognition fixes, greetings off, cut at a
    word, first letter upper-cased, a final stop."""
    out = F.regexp_replace(normalize_text(c), r"^[ \-–—,;:]+|[ \-–—,;:]+$", "")
    for wrong, right in ASR_FIXES:
        out = F.regexp_replace(out, "(?iU)" + wrong, right)
    for greeting in (r"(?iu)^(thưa|kính thưa) quý vị[, ]+", r"(?iu)^(các bạn ơi|các bạn thân mến)[, ]+"):
        out = F.regexp_replace(out, greeting, "")
    cut = F.regexp_replace(F.regexp_replace(F.substring(out, 1, most + 1), r" [^ ]*$", ""), r"[ ,;:]+$", "")
    return sentence(F.when(F.length(out) > most, F.concat(cut, F.lit("…"))).otherwise(out))


def keyword_union(*lists: Column) -> Column:
    """Keywords of all lists in order, each folded text once, blank ones left out."""
    words = F.filter(F.concat(*lists), lambda w: fold_key(w) != "")
    folded = F.transform(words, fold_key)
    return F.filter(words, lambda w, i: F.array_position(folded, fold_key(w)) == i + 1)
