"""Metadata from transcripts: statistics over the collection, informative segments, leads, terms and key points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BOILERPLATE, STOPWORDS, clean_text, content_tokens, fold_key, is_boilerplate, jaccard, normalize_text
from .walk import Walk, walk

# Phrases that open a new story, and phrases that are no subject, folded.
LEAD_CUES = ["trong phan sau", "tiep theo", "mo dau chuong trinh", "thong tin an ninh", "thong tin quoc te"]
STOP_PHRASES = ["video hap dan", "kenh ghien", "subscribe", "tin tuc nhanh", "tin thoi su", "tin tuc the gioi", "chuong trinh mon", "hap dan", "video", "kenh", "chuong trinh"]
HEADLINE_CUES = ["noi bat sau day", "noi dung dang chu y sau day", "noi dung chinh sau day", "thong tin duoc quan tam"]

# Where the promotion in a line of a source's description begins, and marks of lines that are nothing else.
DESCRIPTION_CUTS = ["http://", "https://", " #", "****************", "👉", "📱", "►", "- Tin tức nhanh", "Tin tức nhanh:", "Facebook:", "TÒA SOẠN"]
DESCRIPTION_PROMOTION = [
    "http://", "https://", "www.", "#", "đăng ký", "subscribe", "fanpage", "tiktok", "youtube", "website", "bản quyền", "copyright", "điện thoại", "email", "theo dõi các kênh",
    "các show hấp dẫn khác", "theo dõi thông tin", "phát sóng lúc", "hàng tuần trên kênh", "htv entertainment", "full playlist", "các chương trình hấp dẫn khác", "tin tức nhanh nhất",
    "kênh thông tin chính thức", "đồng hành cùng", "cảm ơn", "video nóng", "tin thời sự", "tin tức thế giới", "địa chỉ", "đường dây nóng", "tòa soạn", "kênh chính thức",
]
# Names of the groups of videos, what their titles repeat, and how their summaries begin.
GROUP_LABELS = {
    "L21": "Thời sự - Bản tin 60 Giây Sáng", "L22": "Thời sự - Bản tin 60 Giây Chiều", "L23": "Thể thao - Đua xe đạp Cúp Truyền hình TP.HCM 2024", "L24": "Thể thao biểu diễn - Lân sư rồng Cúp Chợ Lớn 2024",
    "L25": "Giáo dục - Ôn thi tốt nghiệp THPT 2024", "L26": "Ẩm thực - Hướng dẫn nấu ăn", "L27": "Du lịch và ẩm thực Việt Nam", "L28": "Phim tài liệu - Văn hóa và đời sống vùng Mê Kông",
    "L29": "Phóng sự - Con người và sinh kế vùng Mê Kông", "L30": "Cộng đồng - Câu chuyện truyền cảm hứng",
}
TITLE_REPEATS = {
    "L21": [r"^60 Giây (Sáng|Chiều)\s*[-–—]?\s*", r"\s*[-–—]?\s*HTV Tin Tức.*$"], "L22": [r"^60 Giây (Sáng|Chiều)\s*[-–—]?\s*", r"\s*[-–—]?\s*HTV Tin Tức.*$"],
    "L25": [r"^BÍ QUYẾT ÔN THI THPT\s*2024\s*"], "L26": [r"\bM[ÓO]N NGON M[ỖO]I NG[ÀA]Y\b.*$", r"\bVIVU TV\b"], "L28": [r"^Tản Mạn Mê Kông,? Đến Và Ở Lại\s*"],
    "L29": [r"^Đôi Mắt M[eê]Kong\s*"], "L30": [r"^Lan tỏa năng lượng tích cực\s*2024\s*"],
}
SUMMARY_INTROS = {
    "L21": 'Bản tin "60 Giây Sáng" ({}) tổng hợp các sự kiện đáng chú ý trong nước và quốc tế.', "L22": 'Bản tin "60 Giây Chiều" ({}) cập nhật thời sự, đời sống và tin quốc tế trong ngày.',
    "L23": "Video thể thao ghi lại diễn biến {}.", "L24": "Video ghi lại tiết mục lân sư rồng {}.", "L25": "Bài giảng ôn thi tốt nghiệp THPT 2024 trình bày {}.",
    "L26": 'Chương trình "Món ngon mỗi ngày" hướng dẫn chế biến {}.', "L27": "Tập du lịch - ẩm thực khám phá {}.",
    "L28": 'Phim tài liệu "Tản mạn Mê Kông, Đến và Ở Lại" ({}) tìm hiểu dòng sông, vùng đất và đời sống cư dân Nam Bộ.', "L29": 'Phóng sự "Đôi Mắt Mê Kông" giới thiệu {}.',
    "L30": "Video kể câu chuyện truyền cảm hứng về {}.",
}
OTHER_LABEL, OTHER_INTRO = "Nội dung video", "Video có nội dung: {}."
SUMMARY_NOTES = {
    "no_speech": "ASR không nhận dạng được lời nói; chủ đề được xác định từ tiêu đề và metadata nguồn.", "missing": "Không tìm thấy kết quả ASR; chủ đề được xác định từ tiêu đề và metadata nguồn.",
    "boilerplate_only": "ASR chủ yếu chứa lời mời đăng ký kênh hoặc lời kết, không đủ dữ liệu để mô tả chi tiết diễn biến.",
}
OTHER_NOTE = "Lời thoại nhận dạng quá ít để tạo bản tóm tắt nội dung đáng tin cậy."
# The group whose transcripts are judged by cues, words of its titles that say nothing, and its cues, folded.
CUED_GROUP, CUED_GROUP_WORDS, CUED_GROUP_CUES = "L24", ["lan", "su", "rong", "cup", "cho", "lon", "htv", "2024", "doan", "mua", "trinh", "dien"], ["lan", "rong", "mai hoa thung", "dia buu", "nam su", "mua rong", "mua lan"]
NEWS_GROUPS, DASHED_GROUPS = ["L21", "L22"], ["L21", "L22", "L28"]

#: Characters of text whose phrases a task holds, about: as many at most, and so many at least before a further task is opened.
CHARS, LEAST_CHARS = 2_000_000, 100_000


def _any_in(text, phrases: list[str]):
    return text.rlike("|".join(phrases))


def segment_frequency(segments: DataFrame) -> DataFrame:
    """Folded segment text and the number of videos that have it."""
    keyed = segments.select("video_id", fold_key(F.col("text")).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.countDistinct("video_id").alias("videos"))


def text_parts(segments: DataFrame) -> int:
    """Parts in which ``segments`` are dealt, so that a task holds the phrases of about CHARS characters of text."""
    chars = segments.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, math.ceil(chars / CHARS), min(segments.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / LEAST_CHARS)))


def phrases(segments: DataFrame, subjects: bool = False, parts: int | None = None) -> DataFrame:
    """(video_id, phrase) for every two and three words in a row of a video's folded words, in the order of its ``segments``
    (video_id, segment_index, text), also across their borders. With ``subjects`` only those that can be subjects: every
    word of three letters, the first and the last no function word, no promotion or greeting in it.

    The words that follow a segment's last ones come from the next two segments that have words, so a video's words are
    never one array. Words are judged once for each place, before phrases are made of them. Videos are dealt in as many parts as
    their text asks for (``parts``, else ``text_parts``), so that what a task makes of them and counts stays the same however long the text is."""
    by = Window.partitionBy("video_id").orderBy("segment_index")
    rows = segments.select("video_id", "segment_index", F.explode(F.array(fold_key(F.col("text")))).alias("key")).where("key <> ''")
    rows = rows.repartition(parts or text_parts(segments), "video_id").withColumn("words", F.split("key", " "))
    head = F.slice("words", 1, 2)
    rows = rows.withColumns({"one": F.lead(head).over(by), "two": F.lead(head, 2).over(by)})
    none = F.array().cast("array<string>")
    n = F.size("words")
    rows = rows.select("video_id", n.alias("n"), F.concat("words", F.slice(F.concat(F.coalesce("one", none), F.coalesce("two", none)), 1, 2)).alias("w"))
    if not subjects:
        made = lambda w, n: F.concat(_pairs(w, n, None), _triples(w, n, None))
        return rows.select("video_id", F.explode(made("w", F.col("n"))).alias("phrase"))
    judged = F.transform("w", lambda w: F.struct(w.alias("w"), ((F.length(w) >= 3) & ~w.isin(STOPWORDS)).alias("edge"), (F.length(w) >= 3).alias("inner")))
    rows = rows.select("video_id", "n", judged.alias("w"))
    kept = rows.select("video_id", F.explode(F.concat(_pairs("w", F.col("n"), True), _triples("w", F.col("n"), True))).alias("phrase"))
    return kept.where(~_any_in(F.col("phrase"), STOP_PHRASES + BOILERPLATE))


def _word(x, judged):
    return x["w"] if judged else x


def _pairs(w: str, n, judged):
    """Of words that start among the first ``n``."""
    space = F.lit(" ")

    def pair(a, b):
        both = F.concat(_word(a, judged), space, _word(b, judged))
        return F.when(a["edge"] & b["edge"], both) if judged else both

    return F.array_compact(F.zip_with(F.slice(F.col(w), F.lit(1), n), F.slice(F.col(w), F.lit(2), n), pair))


def _triples(w: str, n, judged):
    space = F.lit(" ")
    follow = F.zip_with(F.slice(F.col(w), F.lit(2), n), F.slice(F.col(w), F.lit(3), n), lambda b, c: F.struct(b.alias("b"), c.alias("c")))

    def triple(a, bc):
        b, c = bc["b"], bc["c"]
        every = F.concat(_word(a, judged), space, _word(b, judged), space, _word(c, judged))
        return F.when(a["edge"] & b["inner"] & c["edge"], every) if judged else every

    return F.array_compact(F.zip_with(F.slice(F.col(w), F.lit(1), n), follow, triple))


def phrase_frequency(segments: DataFrame) -> DataFrame:
    """Folded phrases of two and three words (``phrases``) and the number of videos that have them."""
    return phrases(segments).distinct().groupBy("phrase").agg(F.count("*").alias("videos"))


def duplicate_transcripts(transcripts: DataFrame) -> DataFrame:
    """Videos whose folded transcripts are equal: hash, smallest video and number of videos. The group's ids are a join
    on the hash away, so a large group is never one row."""
    keyed = transcripts.select("video_id", F.sha2(fold_key(F.col("text")), 256).alias("text_hash"))
    return keyed.groupBy("text_hash").agg(F.min("video_id").alias("first_video"), F.count("*").alias("videos")).where("videos > 1")


def informative_segments(segments: DataFrame, frequency: DataFrame, least_tokens: int = 3, common: int = 4, short: int = 18) -> DataFrame:
    """First segment of each folded text in a video that is no boilerplate, has three content tokens, and is not a short
    text that many videos share."""
    rows = segments.withColumns({"key": fold_key(F.col("text")), "tokens": F.size(content_tokens(F.col("text")))}).where("key <> ''")
    first = Window.partitionBy("video_id", "key").orderBy("segment_index", "segment_id")
    rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    rows = rows.where((F.col("tokens") >= least_tokens) & ~is_boilerplate(F.col("text"))).join(frequency, "key")
    return rows.where(~((F.col("videos") >= common) & (F.col("tokens") < short)))


def news_leads(segments: DataFrame, after: float = 30.0, gap: float = 2.4) -> DataFrame:
    """Segments from ``after`` seconds on that follow a pause or hold a cue of a new story."""
    by = Window.partitionBy("video_id").orderBy("segment_index", "segment_id")
    rows = segments.withColumn("pause", F.col("start_time") - F.coalesce(F.lag("end_time").over(by), F.lit(0.0)))
    return rows.where((F.col("start_time") >= after) & ((F.col("pause") >= gap) | _any_in(fold_key(F.col("text")), LEAD_CUES)))


def news_headlines(segments: DataFrame, until: float = 38.0) -> DataFrame:
    """Segments of the headline block: after the first cue among a video's first twelve segments (or from the start),
    up to ``until`` seconds, of five content tokens at least."""
    by = Window.partitionBy("video_id").orderBy("segment_index", "segment_id")
    rows = segments.withColumns({"no": F.row_number().over(by), "cue": _any_in(fold_key(F.col("text")), HEADLINE_CUES)})
    rows = rows.withColumn("first_cue", F.min(F.when(F.col("cue") & (F.col("no") <= 12), F.col("no"))).over(Window.partitionBy("video_id")))
    late = F.coalesce(F.max((F.col("start_time") > until).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    kept = rows.where(F.col("no") > F.coalesce("first_cue", F.lit(0))).withColumn("late", late).where("late = 0")
    return kept.where(~is_boilerplate(F.col("text")) & (F.size(content_tokens(F.col("text"))) >= 5))


def transcript_status(total_words, informative_words, logprob, chosen, error):
    """(status, quality) of a transcript, as a struct."""
    pair = lambda a, b: F.struct(F.lit(a).alias("status"), F.lit(b).alias("quality"))
    return (F.when(~chosen & error, pair("no_speech", "unavailable")).when(~chosen, pair("missing", "unavailable"))
            .when((total_words <= 25) | (informative_words <= 20), pair("insufficient", "low")).when(informative_words / F.greatest(total_words, F.lit(1)) < 0.12, pair("boilerplate_only", "low"))
            .when(informative_words < 140, pair("sparse", "low")).when((informative_words >= 700) & (logprob >= -0.35), pair("usable", "high")).otherwise(pair("usable", "medium")))


def title_coverage(title, text):
    """Share of the title's content tokens (no numbers, three letters at least) that the text has; null without any."""
    tokens = F.array_distinct(F.filter(content_tokens(title), lambda w: ~w.rlike("^[0-9]+$") & (F.length(w) >= 3)))
    return F.when((F.size(tokens) > 0) & (text != ""), F.round(F.size(F.array_intersect(tokens, content_tokens(text))) / F.size(tokens), 3))


def subject_scores(segments: DataFrame, titles: DataFrame) -> DataFrame:
    """(video_id, phrase, count, score): phrases of two or three words that can be subjects (``phrases``), twice at least or
    wholly in the title (``titles``: video_id, title; one row for each video with segments); a word of the title doubles the
    count. Score: (1 + ln count) * ln((N + 1) / (videos + 1) + 1). Phrases are made once: a video's are counted where it stands, and go
    to their phrase with the video's count, where videos are counted."""
    n = titles.agg(F.count("*").alias("n_videos"))
    parts = text_parts(segments)
    counted = phrases(segments, True, parts).groupBy("video_id", "phrase").agg(F.count("*").alias("said"))
    titled = titles.repartition(parts, "video_id")  # where the phrases stand, so that these stay
    rows = counted.join(titled.select("video_id", F.explode(F.array(content_tokens(F.col("title")))).alias("title_tokens")), "video_id")
    words = F.split("phrase", " ")
    rows = rows.withColumn("count", F.col("said") * (1 + F.arrays_overlap(words, F.col("title_tokens")).cast("int")))
    in_title = F.size(F.array_except(F.filter(words, lambda w: ~w.isin(STOPWORDS)), F.col("title_tokens"))) == 0
    rows = rows.select("video_id", "phrase", "count", ((F.col("count") >= 2) | in_title).alias("kept"))
    rows = rows.withColumn("videos", F.count("*").over(Window.partitionBy("phrase")))  # a row for each video at most
    kept = rows.where("kept").crossJoin(F.broadcast(n))  # one row
    score = (1 + F.log("count")) * F.log((F.col("n_videos") + 1) / (F.col("videos") + 1) + 1)
    return kept.select("video_id", "phrase", "count", F.round(score, 6).alias("score"))


def subject_terms(scores: DataFrame, k: int = 8, most_alike: float = 0.65) -> DataFrame:
    """The best ``k`` phrases of each video, none too like a better one. A task holds a video's chosen phrases alone."""
    class Pick(Walk):
        def __init__(self):
            self.chosen: list[set] = []

        def step(self, row):
            words = {w for w in row["phrase"].split() if w not in STOPWORDS}
            if any(len(words & other) / max(1, len(words | other)) >= most_alike for other in self.chosen):
                return None
            self.chosen.append(words)
            self.done = len(self.chosen) == k
            return {"video_id": row["video_id"], "rank": len(self.chosen), "phrase": row["phrase"], "score": row["score"]}

    return walk(scores.select("video_id", "phrase", "score"), ["video_id"], [F.desc("score"), "phrase"], Pick, "video_id string, rank int, phrase string, score double")


def unique_topics(topics: DataFrame) -> DataFrame:
    """Topics that several videos share get the video's id."""
    rows = _shared(topics, "topic", "__shared")
    return rows.withColumn("topic", F.when(F.col("__shared"), F.concat("topic", F.lit(" ["), "video_id", F.lit("]"))).otherwise(F.col("topic"))).drop("__shared")


def sentence_windows(segments: DataFrame, short: int = 120, gap: float = 2.5, most: int = 280) -> DataFrame:
    """From each segment, its text with the following ones while it is shorter than ``short``, the pause is not above
    ``gap`` and the sum not above ``most`` characters. Each joined segment adds a space at least, so a window ends
    within ``short`` segments and a frame of so many rows holds it, however long the video."""
    following = Window.partitionBy("video_id").orderBy(F.asc_nulls_last("segment_index"), F.asc_nulls_last("segment_id")).rowsBetween(1, max(1, short))
    rows = segments.select("video_id", "segment_id", "segment_index", "start_time", "end_time", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("next", F.collect_list(F.struct("start_time", "end_time", "text")).over(following))

    def step(acc, x):
        joins = acc["open"] & (F.length(acc["text"]) < short) & (x["start_time"] - acc["end"] <= gap) & (F.length(acc["text"]) + F.length(x["text"]) <= most)
        grown = F.struct(F.concat(acc["text"], F.lit(" "), x["text"]).alias("text"), x["end_time"].alias("end"), F.lit(True).alias("open"))
        return F.when(joins, grown).otherwise(F.struct(acc["text"].alias("text"), acc["end"].alias("end"), F.lit(False).alias("open")))

    first = F.struct(F.col("text").alias("text"), F.col("end_time").alias("end"), F.lit(True).alias("open"))
    rows = rows.withColumn("window", F.aggregate("next", first, step))
    return rows.select("video_id", "segment_id", "start_time", F.col("window.end").alias("end_time"), F.col("window.text").alias("text"))


def window_scores(windows: DataFrame, segments: DataFrame, titles: DataFrame) -> DataFrame:
    """Windows of six content tokens at least with their score: centrality of tokens, overlap with the title, digits and
    length."""
    freq = segments.select("video_id", F.explode(content_tokens(F.col("text"))).alias("token")).groupBy("video_id", "token").agg(F.count("*").alias("f"))
    freq = freq.withColumn("share", F.col("f") / F.max("f").over(Window.partitionBy("video_id")))
    rows = windows.withColumn("tokens", content_tokens(F.col("text"))).where(F.size("tokens") >= 6)
    central = rows.select("video_id", "segment_id", F.explode("tokens").alias("token")).join(freq, ["video_id", "token"]).groupBy("video_id", "segment_id").agg(F.sum("share").alias("central"))
    rows = rows.join(central, ["video_id", "segment_id"]).join(titles.select("video_id", F.array_distinct(content_tokens(F.col("title"))).alias("title_tokens")), "video_id")
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    n = F.size("tokens")
    score = F.col("central") / F.sqrt(n) + 2.0 * F.size(F.array_intersect("tokens", "title_tokens")) / F.greatest(F.lit(1), F.size("title_tokens")) + F.least(F.lit(0.35), 0.08 * digits) + F.least(F.lit(0.45), n / 80)
    return rows.select("video_id", "segment_id", "start_time", "end_time", "text", "tokens", F.round(score, 6).alias("score"))


def key_points(windows: DataFrame, k: int = 5) -> DataFrame:
    """Points of each video by repeated choice of the best score less 1.6 times the greatest likeness to a chosen one,
    plus 0.35 for a fifth of the timeline not used yet (ties to the earlier); windows too like a chosen one leave. In time
    order. Each choice is the first row of a sort of the video's windows, so no video is gathered in memory."""
    video = Window.partitionBy("video_id")
    rows = windows.select(
        "video_id", "segment_id", "start_time", "text", "score", F.array_distinct("tokens").alias("tokens"),
        F.least(F.lit(4), (5 * F.col("start_time") / F.greatest(F.max("end_time").over(video), F.lit(1.0))).cast("int")).alias("fifth"),
        F.lit(0.0).alias("like"), F.array().cast("array<int>").alias("used"), F.lit(True).alias("open"), F.lit(False).alias("picked"))
    for _ in range(k):
        value = F.col("score") - 1.6 * F.col("like") + 0.35 * (~F.array_contains("used", F.col("fifth"))).cast("int")
        order = video.orderBy(F.desc("open"), value.desc(), "start_time", "segment_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("best", F.first(F.struct("open", "segment_id", "tokens", "fifth")).over(order))
        rows = rows.withColumns({"near": jaccard(F.col("tokens"), F.col("best.tokens")), "own": F.col("best.open") & (F.col("segment_id") == F.col("best.segment_id"))})
        rows = rows.withColumns({"picked": F.col("picked") | F.col("own"), "open": F.col("open") & ~F.col("own") & (F.col("near") < 0.76), "like": F.greatest("like", "near"),
                                 "used": F.array_append("used", F.col("best.fifth"))}).drop("best", "near", "own")
    by = video.orderBy("start_time", "segment_id")
    return rows.where("picked").withColumn("point_no", F.row_number().over(by)).select("video_id", "point_no", "segment_id", "text", "score")


def _strip(c, characters: str):
    return F.regexp_replace(c, f"^[{characters}]+|[{characters}]+$", "")


def _by(group, values: dict[str, str], other: str):
    """The value of a group from a short fixed table."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[group], F.lit(other))


def _within(text, marks: list[str]):
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return found


def distinct_texts(texts, threshold: float):
    """Cleaned texts of an array in order that have three content tokens and are not too like a kept one."""
    pairs = F.transform(texts, lambda t: F.struct(clean_text(t).alias("text"), content_tokens(clean_text(t)).alias("tokens")))
    step = lambda kept, x: F.when((F.size(x["tokens"]) >= 3) & ~F.exists(kept, lambda k: jaccard(F.array_distinct(x["tokens"]), F.array_distinct(k["tokens"])) >= threshold), F.concat(kept, F.array(x))).otherwise(kept)
    start = F.expr("cast(array() as array<struct<text:string,tokens:array<string>>>)")
    return F.transform(F.aggregate(pairs, start, step), lambda k: k["text"])


def clean_description(c, k: int = 3):
    """The editorial paragraphs of a source's description, ``k`` at most: promotion at a line's end cut off, lines of nothing
    else left out, paragraphs of seven content tokens at least, none too like an earlier one."""
    def line(raw):
        plain = _strip(normalize_text(raw), r" \-–—\t")
        at = [F.when(F.instr(plain, m) > 0, F.instr(plain, m)) for m in DESCRIPTION_CUTS]
        cut = F.when(F.coalesce(*at).isNull(), plain).otherwise(F.substring(plain, F.lit(1), F.least(*[F.coalesce(x, F.lit(1 << 30)) for x in at]) - 1))
        return _strip(cut, r" \-–—|:")

    def paragraph(block):
        lines = F.filter(F.transform(F.split(block, r"\r?\n"), line), lambda x: (x != "") & ~_within(F.lower(x), DESCRIPTION_PROMOTION))
        return F.trim(F.array_join(lines, " "))

    made = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), paragraph), lambda p: (F.size(content_tokens(p)) >= 7) & ~is_boilerplate(p) & ~_within(F.lower(p), DESCRIPTION_PROMOTION))
    return F.slice(distinct_texts(F.transform(made, lambda p: clean_text(p, 460)), 0.68), 1, k)


def title_detail(group, title):
    """A title without what its group's titles repeat; the whole title if nothing else is left."""
    plain = _strip(normalize_text(title), r" \-|–—")
    detail = plain
    for name, patterns in TITLE_REPEATS.items():
        own = plain
        for p in patterns:
            own = F.regexp_replace(own, "(?iu)" + p, "")
        detail = F.when(group == name, _strip(own, r" \-|–—")).otherwise(detail)
    return F.coalesce(F.nullif(detail, F.lit("")), title)


def topic_for(group, title, description=None):
    """The group's label and the title's detail. For the group whose titles say little, the first paragraph of the source's
    description (``clean_description``) takes the detail's place if the detail has under four content tokens."""
    detail = title_detail(group, title)
    label = _by(group, GROUP_LABELS, OTHER_LABEL)
    topic = F.concat(label, F.when(group.isin(DASHED_GROUPS), F.lit(" - ")).otherwise(F.lit(": ")), detail)
    if description is None:
        return topic
    first = F.try_element_at(clean_description(description), F.lit(1))
    return F.when((group == CUED_GROUP) & (F.size(content_tokens(detail)) < 4) & first.isNotNull(), F.concat(label, F.lit(": "), first)).otherwise(topic)


def topic_conflict(group, title, text, coverage):
    """Whether a transcript seems to belong to another title: hardly any of the title's tokens (``title_coverage`` of the
    title's detail) in it. News are left out; the cued group is judged by its cues and the title's own words."""
    detail = content_tokens(title_detail(group, title))
    spoken = content_tokens(text)
    own = F.array_except(F.array_distinct(detail), F.array(*map(F.lit, CUED_GROUP_WORDS)))
    overlap = F.size(F.array_intersect(own, spoken)) / F.greatest(F.lit(1), F.size(own))
    cued = (F.size(spoken) >= 80) & ~_within(fold_key(text), CUED_GROUP_CUES) & (overlap < 0.2)
    other = coverage.isNotNull() & ~group.isin(NEWS_GROUPS) & (coverage < 0.12) & (F.size(detail) >= 5)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(False)).when(group == CUED_GROUP, cued).otherwise(F.coalesce(other, F.lit(False)))


def summaries(videos: DataFrame) -> DataFrame:
    """Summary of each video (video_id, group, title, points, status): the group's intro with the title's detail, then the
    points as a list, or a note on the transcript."""
    detail = title_detail(F.col("group"), F.col("title"))
    intro = F.replace(_by(F.col("group"), SUMMARY_INTROS, OTHER_INTRO), F.lit("{}"), detail)
    points = F.concat(F.lit("\n\nNội dung chính:\n"), F.array_join(F.transform("points", lambda p: F.concat(F.lit("- "), p)), "\n"))
    note = F.concat(F.lit("\n\nGhi chú dữ liệu: "), _by(F.col("status"), SUMMARY_NOTES, OTHER_NOTE))
    return videos.select("video_id", F.concat(intro, F.when(F.size("points") > 0, points).otherwise(note)).alias("summary"))


def enrichment_report(videos: DataFrame) -> DataFrame:
    """Counts by status (video_id, status, summary, conflict, text_hash): videos, title conflicts, summaries and
    transcripts that other videos share."""
    rows = _shared(_shared(videos, "summary", "same_summary"), "text_hash", "same_text")
    return rows.groupBy("status").agg(F.count("*").alias("videos"), F.count_if("conflict").alias("conflicts"), F.count_if("same_summary").alias("duplicate_summaries"), F.count_if("same_text").alias("duplicate_transcripts"))


def _shared(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Whether other rows have the column's value; counted before it is joined back, so that a common value is no one task's
    work but that of the few rows that are counted."""
    n = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n")).where("__n > 1")
    return rows.join(n, F.col(column) == F.col("__v"), "left").withColumn(name, F.col("__n").isNotNull()).drop("__v", "__n")


def enrichment_problems(videos: DataFrame) -> DataFrame:
    """(kind, key, video_id): videos whose title conflicts, and those whose summary or transcript others share, with the
    hash that they share as key. A group is as many rows as it has videos, never one array."""
    rows = _shared(_shared(videos, "summary", "same_summary"), "text_hash", "same_text")
    kinds = F.array_compact(F.array(F.when(F.col("conflict"), F.struct(F.lit("conflict").alias("kind"), F.lit("").alias("key"))), F.when(F.col("same_summary"), F.struct(F.lit("summary").alias("kind"), F.sha2("summary", 256).alias("key"))),
                                    F.when(F.col("same_text"), F.struct(F.lit("transcript").alias("kind"), F.col("text_hash").alias("key")))))
    return rows.select(F.explode(kinds).alias("p"), "video_id").select("p.kind", "p.key", "video_id")
