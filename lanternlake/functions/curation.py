"""Rules over questions, answers and transcripts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOPIC = "General Guidance"
# Topics with the substrings that decide them, tried in this order.
TOPIC_RULES = [
    ("Login & Account Issues", ["đăng nhập", "login", "mật khẩu"]),
    ("Exam System Errors", ["lỗi hệ thống", "crash", "không load", "treo web"]),
    ("Submission Problems", ["nộp bài", "submit", "không nộp được"]),
    ("Network & Connection Issues", ["mạng", "wifi", "disconnect", "lag"]),
    ("Device & Hardware Issues", ["máy", "bàn phím", "chuột", "camera"]),
    ("Exam Regulations & Violations", ["gian lận", "vi phạm", "quy chế"]),
    ("Proctoring & Monitoring", ["giám sát", "camera", "theo dõi"]),
    ("Emergency Situations", ["mất điện", "khẩn cấp", "sự cố"]),
]


def topic(question: Column) -> Column:
    """First topic one of whose substrings the lower-case question contains."""
    q, out = F.lower(question), F
    for name, words in TOPIC_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = out.when(hit, name)
    return out.otherwise(DEFAULT_TOPIC)


def intent(folded: Column) -> Column:
    """Product that a folded question asks about, or null; earlier products win."""
    has = folded.contains
    return (
        F.when(has("pea") | folded.rlike(r"\bthi\s+thuc\s+hanh\b") | has("phan mem thi thuc hanh"), "pea")
        .when(has("eos") | has("ly thuyet"), "eos")
        .when(has("e360") | has("speaking"), "e360")
    )


# Words that a product is known by in a text.
INTENT_WORDS = {"pea": ("pea", "thuc hanh"), "eos": ("eos", "ly thuyet"), "e360": ("e360", "speaking")}


def intent_factor(asked: Column, folded: Column) -> Column:
    """1.12 for a text of the asked product, 0.88 for a text of only others, else 1."""
    present = {k: folded.contains(a) | folded.contains(b) for k, (a, b) in INTENT_WORDS.items()}
    mine, anyone = F.lit(False), F.lit(False)
    for k, p in present.items():
        mine, anyone = mine | ((asked == k) & p), anyone | p
    return F.when(asked.isNull(), 1.0).when(mine, 1.12).when(anyone, 0.88).otherwise(1.0)


# Transcription errors and their corrections in order, and terms that a correction must keep.
VOICE_FIXES = [
    ("phòng thu", "phòng thi"),
    ("phòng thử", "phòng thi"),
    ("giám thi", "giám thị"),
    ("giam thi", "giám thị"),
    ("wifi", "Wi-Fi"),
    ("usb", "USB"),
]
VOICE_TERMS = ("khảo thí", "USB", "Wi-Fi", "FPT", "PEA", "PEALogin", "EOS", "EOSClient")
QUERY_TERMS = ("khảo thí", "phòng thi", "giám thị", "FPT", "USB", "Wi-Fi", "PEA", "PEALogin", "EOS", "EOSClient")


def voice_fixes(text: Column) -> Column:
    """Known transcription errors corrected as whole words, whatever their case; single spaces."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    for wrong, right in VOICE_FIXES:
        out = F.regexp_replace(out, rf"(?iuU)\b{wrong}\b", right)
    return out


def preserves_terms(source: Column, new: Column, terms=VOICE_TERMS) -> Column:
    """Whether every protected term of ``source`` is in ``new`` too, whatever its case."""
    a, b, out = F.lower(source), F.lower(new), F.lit(True)
    for t in terms:
        out = out & (~a.contains(t.lower()) | b.contains(t.lower()))
    return out


CITATION = r"(?iu)\[\s*(?:(?:sử dụng|nguồn|tham khảo|evidence)\s*:?\s*)?E\s*(\d+)\s*\]"


def normalise_citations(answer: Column) -> Column:
    """Variants of a citation as ``[E1]``."""
    return F.regexp_replace(answer, CITATION, "[E$1]")


def cited(answer: Column) -> Column:
    """Evidence ids in order of appearance, with repeats."""
    return F.transform(F.regexp_extract_all(normalise_citations(answer), F.lit(r"\[[Ee](\d+)\]"), 1), lambda n: F.concat(F.lit("E"), n))


# What goes with a citation, in this order.
CITATION_TIDY = (
    (r"\[[Ee]\d+\]", ""), (r"[ \t]+(?=\n|\z)", ""), (" {2,}", " "), (r"\s+([,.;:!?])", "$1"), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", ""),
)


def strip_citations(answer: Column) -> Column:
    """The answer without citations and the untidy space they leave."""
    return reduce(lambda text, rule: F.regexp_replace(text, *rule), CITATION_TIDY, normalise_citations(answer))


def repair_dates(text: Column) -> Column:
    """Dates whose year a reader has split, such as 01.02.20.24, in one piece."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<!\d)(\d{1,2}[./_-]\d{1,2}[./_-])20[./_-](\d{2})(?!\d)", "$120$2")


def parse_verdict(reply: Column) -> Column:
    """Struct (relevant, error_text) of the outermost JSON object in a model's reply.

    Only the JSON boolean true with a text of 1 to 500 characters, white space collapsed, is relevant;
    everything else is not relevant and has no text.
    """
    json = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    field = lambda name, kind: F.when(
        F.schema_of_variant(F.try_variant_get(json, f"$.{name}", "variant")) == kind.upper(), F.try_variant_get(json, f"$.{name}", kind)
    )
    text = F.trim(F.regexp_replace(field("error_text", "string"), r"(?U)\s+", " "))
    good = F.coalesce(field("relevant", "boolean") & F.length(text).between(1, 500), F.lit(False))
    return F.struct(good.alias("relevant"), F.when(good, text).otherwise("").alias("error_text"))


def procedural_overview(question_folded: Column, answer_folded: Column) -> Column:
    """The question asks for a whole procedure, and the answer numbers two or more different steps."""
    one_step = question_folded.rlike(r"\b(?:buoc|step)\s*\d+\b")
    asks = F.lit(False)
    for phrase in ("huong dan", "cac buoc", "cach lam", "lam sao", "how to"):
        asks = asks | question_folded.contains(phrase)
    steps = F.regexp_extract_all(answer_folded, F.lit(r"(?m)(?:^|\n)\s*(?:buoc\s*)?(\d+)\s*[.):]"), 1)
    return ~one_step & asks & (F.size(F.array_distinct(steps)) >= 2)


def question_with_image(question: Column, image_text: Column, valid: Column) -> Column:
    """The question and what an image adds to it, without empty parts; an image that is not valid adds nothing."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws("\n", part(question), F.when(valid, part(image_text)))


def size_label(size: Column) -> Column:
    """Bytes as B, KB or MB with one decimal, ties upward."""
    return (
        F.when(size < 1024, F.format_string("%d B", size))
        .when(size < 1048576, F.format_string("%.1f KB", size / 1024))
        .otherwise(F.format_string("%.1f MB", size / 1048576))
    )


def axis_label(day: Column, group: str) -> Column:
    """Short label of a bucket on a chart axis."""
    return F.date_format(day, {"day": "dd/MM", "week": "dd/MM", "month": "MM/yyyy", "year": "yyyy"}[group])
