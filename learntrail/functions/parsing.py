"""Column functions that parse fields of an attempt log. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS_MODES = ("integer", "bits", "head", "text", "no_dots", "plain", "raw")


def parse_pass(c: Column, mode: str = "integer") -> Column:
    """The bit string of unit-test results under one of the modes in use.

    integer: a float's text loses its fraction and leading zeros; bits: that, and only 0 and 1 stay; head: the part before the
    dot, none if it is zero; text, plain, raw: as it is; no_dots: dots go. Null stays null.
    """
    whole = F.when(c.contains("."), F.try_to_number(c, F.lit("999999999999999999.999")).cast("decimal(38,0)").cast("string")).otherwise(c)
    if mode == "integer":
        return whole
    if mode == "bits":
        return F.regexp_replace(whole, "[^01]", "")
    if mode == "head":
        return F.when(c.isin("0.0", "0"), F.lit("")).otherwise(F.substring_index(c, ".", 1))
    if mode == "no_dots":
        return F.replace(c, F.lit("."), F.lit(""))
    if mode in ("text", "plain", "raw"):
        return c
    raise ValueError(f"mode {mode!r} is not one of {PASS_MODES}")


def pass_count(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("1"), F.lit("")))).cast("long")


def pass_fraction(c: Column) -> Column:
    """The share of ones; null for an empty string."""
    return F.try_divide(pass_count(c).cast("double"), F.length(c).cast("double"))


def marks(c: Column) -> Column:
    return pass_fraction(c) * 10


def is_perfect(c: Column) -> Column:
    return F.coalesce(c.rlike("^1+$"), F.lit(False))


def parse_timestamp(c: Column) -> Column:
    """Day-first text as a timestamp; null if it can't be read. One-digit days and hours are read too."""
    return F.try_to_timestamp(c, F.lit("d/M/yy, H:mm:ss"))


def course_days(ts: Column, start: Column) -> Column:
    """Days since the course began, at least 0; null without a timestamp."""
    return F.when(ts.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(ts) - F.unix_micros(start)) / 8.64e10))


def action_type(c: Column) -> Column:
    return F.when(c.startswith("Prechecked"), "Prechecked").when(c.startswith("Submit"), "Submit").when(c.startswith("Saved"), "Saved").when(c.startswith("Attempt finished"), "Finished").when(c.startswith("Started"), "Started").otherwise("")


def action_text(c: Column) -> Column:
    """What follows the action's prefix; each prefix that begins the text goes wherever it stands."""
    for prefix in ("Prechecked: ", "Submit: ", "Saved: "):
        c = F.when(c.startswith(prefix), F.replace(c, F.lit(prefix), F.lit(""))).otherwise(c)
    return c


def max_score(c: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"/(\d+\.\d+)", 1), F.lit("")), F.lit("999999.99")).cast("double")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unit_tests(c: Column) -> Column:
    """Blocks 'Unittest n: / Input: / STD input: / Output:' as an array of structs; empty if any block lacks a part."""
    block = F.transform(F.slice(F.split(c, "Unittest"), 2, 1_000_000), lambda x: F.substring(x, F.instr(x, ":") + 1, F.length(x)))
    whole = F.forall(block, lambda x: x.contains("Input:") & x.contains("STD input:") & x.contains("Output:"))
    part = lambda x, a, b: _stripped(F.substring(x, F.instr(x, a) + len(a), F.greatest(F.instr(x, b) - F.instr(x, a) - len(a), F.lit(0)) if b else F.length(x)))
    made = F.transform(block, lambda x: F.struct(part(x, "Input:", "STD input:").alias("input"), part(x, "STD input:", "Output:").alias("std_in"), part(x, "Output:", None).alias("output")))
    return F.when(whole, made).otherwise(F.array().cast("array<struct<input:string,std_in:string,output:string>>"))


def format_unit_tests(tests: Column) -> Column:
    """The blocks of ``unit_tests``, numbered from 0, parted by an empty line."""
    return F.array_join(F.transform(tests, lambda x, i: F.concat(F.lit("Unittest "), i.cast("string"), F.lit(":\nInput: "), x["input"], F.lit("\nSTD input: "), x["std_in"], F.lit("\nOutput: "), x["output"])), "\n\n")


def last_action_tag(c: Column) -> Column:
    """The last [Precheck] or [Submit] tag; Submit without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?i)\[(Precheck|Submit)\]"), 1), F.lit(-1)), F.lit("Submit"))


def fenced_code(c: Column) -> Column:
    """The first code fence after the last action tag; else the last fence; else the trimmed text."""
    tail = F.regexp_extract(c, r"(?is)^.*\[(?:Precheck|Submit)\](.*)$", 1)
    fence = r"(?s)```[A-Za-z+]*\n(.*?)```"
    after = F.regexp_extract(tail, fence, 1)
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(fence), 1), F.lit(-1))
    return F.trim(F.coalesce(F.nullif(after, F.lit("")), last, c), F.lit(" \n"))


def first_tokens(c: Column, n: int = 150) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def truncate_lines(c: Column, n: int = 40, marker: str = "... (truncated)") -> Column:
    lines = F.split(c, "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n" + marker))).otherwise(c)


#: Endings of a topic that name the kind of session.
SESSION_ENDINGS = ("_Inlab", "_Prelab", "_Postlab", "_InLab", "_PreLab", "_PostLab")
#: A section's letters and its type; other letters are Regular.
SECTION_TYPES = {"L": "Regular", "CC": "Credit-Constrained", "CN": "Compact", "DT": "Deferred/Repeat"}
#: Characters that LaTeX reads, in the order in which they are replaced.
LATEX = {"_": "\\_", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "{": "\\{", "}": "\\}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}


def normalize_topic(c: Column) -> Column:
    """Exams are one topic; of other topics one ending that names the kind of session goes, and underscores are spaces."""
    bare = F.regexp_replace(c, f"({'|'.join(SESSION_ENDINGS)})$", "")
    return F.when(c.startswith("Exam"), "Exam").otherwise(_stripped(F.replace(bare, F.lit("_"), F.lit(" "))))


def section_type(c: Column) -> Column:
    """The type that belongs to exactly the letters of a section's name."""
    letters = F.upper(F.regexp_replace(c, r"\P{L}", ""))
    out = F.lit("Regular")
    for key, value in SECTION_TYPES.items():
        out = F.when(letters == key, value).otherwise(out)
    return out


def escape_latex(c: Column) -> Column:
    for old, new in LATEX.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def course_label(c: Column) -> Column:
    """A course code such as pf_hk232 as its name and semester: two digits of the year and the semester's digit follow ``_hk``."""
    code = F.lower(c)
    kind = F.when(code.startswith("pf"), "Programming Fundamentals").when(code.startswith("dsa"), "Data Structures \\& Algorithms").otherwise(F.upper(F.substring_index(code, "_", 1)))
    term = F.substring(F.get(F.split(code, "_hk"), F.lit(1)), 1, 3)
    season = F.when(F.substring(term, 3, 1) == "1", "Fall").otherwise("Spring")
    return F.when(code.contains("_hk"), F.concat(kind, F.lit(" ("), season, F.lit(" 20"), F.substring(term, 1, 2), F.lit(")"))).otherwise(kind)


def duration(seconds: Column) -> Column:
    """Seconds under a minute, minutes under an hour, else hours; halves are rounded up."""
    shown = lambda x, digits: F.format_string(f"%.{digits}f", x + 1e-9)
    return F.when(seconds < 60, F.concat(shown(seconds, 0), F.lit(" seconds"))).when(seconds < 3600, F.concat(shown(seconds / 60, 1), F.lit(" minutes"))).otherwise(F.concat(shown(seconds / 3600, 1), F.lit(" hours")))


def smoothed(y: Column, eps: float = 0.01) -> Column:
    """Labels drawn in from 0 and 1."""
    return y * (1 - 2 * eps) + eps


def uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) that depends on the seed and the columns' values alone, the same at every size and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("double") / 4294967296


def strip_heading_lines(c: Column) -> Column:
    return F.trim(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.startswith("#")), "\n"), F.lit(" \n"))


def prepare_embed_text(c: Column, most: int = 16_384) -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit("")), F.lit(" \n\t")) == "", "# empty").otherwise(F.substring(c, 1, most))


def recency_weight(age_days: Column, half_life: float = 28.0) -> Column:
    return F.exp(F.lit(-0.693) * age_days / half_life)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clipped(p: Column, eps: float = 1e-7) -> Column:
    return F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))


def bernoulli_loglik(y: Column, logit: Column) -> Column:
    """y x - softplus(x), in the form that doesn't overflow."""
    return y * logit - (F.greatest(logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit))))


def kl_categorical(p: Column, q: Column, eps: float = 1e-8) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: a * (F.ln(a + eps) - F.ln(b + eps))), F.lit(0.0), lambda s, v: s + v)


def pad_vector(a: Column, size: int, fill: int = -1) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), size)), 1, size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalize_question(c: Column) -> Column:
    """A question's text without its page's header and what follows the answer box."""
    c = F.when(c.contains("Question text "), F.trim(F.replace(c, F.lit("Question text "), F.lit("")))).otherwise(c)
    return F.when(c.contains("Answer:(penalty regime:"), F.trim(F.substring_index(c, "Answer:(penalty regime:", 1))).otherwise(c)


def question_words(c: Column, most: int = 150) -> Column:
    """The first words of a normalised question with single spaces."""
    words = F.filter(F.split(normalize_question(c), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, most), " ")
