"""Text functions as Spark expressions. Patterns use explicit ASCII classes, so that every engine agrees."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "(?i)(^|[^a-z0-9_])", "($|[^a-z0-9_])"
#: What a spoken text must not hold, in the order in which it is looked for.
FORBIDDEN = (
    ("em dash", "—"),
    ("semicolon", ";"),
    ("parenthesis", r"[()]"),
    ("hesitation filler", START + "(uh|um|er|erm|hmm)" + END),
    ("phone call marker", START + "are you (still |)there" + END),
    ("speakerphone", START + "speakerphone" + END),
    ("phone call marker", START + r"hold on,?[ \t\r\n]+i'?m on (a|the|another) call" + END),
    ("phone call marker", START + "can you hear me" + END),
    ("speaker label", r"(?i)^(A|B)[ \t\r\n]*:"),
    ("stage direction", r"\*[^*]+\*"),
    ("tags only", r"^[ \t\r\n]*(\[[^\]]+\][ \t\r\n]*)+$"),
    ("worn phrasing: what was I saying", "(?i)what was i saying"),
    ("worn phrasing: where was I", r"(?i)where was i[ \t\r\n]*[?.!]"),
    ("worn phrasing: where were we", r"(?i)where were we[ \t\r\n]*[?.!]"),
    ("worn phrasing: what were we talking about", "(?i)what were we talking about"),
    ("worn phrasing: what was the last thing I said", "(?i)what was the last thing i (said|was saying)"),
    ("worn phrasing: I lost my train of thought", "(?i)lost my train of thought"),
    ("worn phrasing: I lost my place", "(?i)lost my place"),
    ("worn phrasing: I've completely lost it", "(?i)completely lost it"),
    ("worn phrasing: sorry, I blanked", "(?i)i blanked"),
)
#: Characters folded to ASCII before quotes are compared (an ellipsis becomes three dots).
FOLDED = ("‘’‚‛′“”„″‐‑‒–—\u00a0\u202f", "'''''\"\"\"\"-----  ")
WORD = re.compile("[a-z']+")
REACTIONS = ("pivot", "verbal", "behavioral", "ambient")


def strip_tags(text: Column) -> Column:
    """Bracketed tags become a blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\[[^\]]+\]", " "))


def strip_markup(html: Column) -> Column:
    """Angle-bracketed tags become a blank, runs of blanks one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"[ \t\r\n]+", " "))


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")


def event_id(category: Column, name: Column) -> Column:
    """An event's id; null without a category or a name."""
    return F.concat(category, F.lit("/"), name)


def event_name(event_id: Column) -> Column:
    """What follows the first slash; an id without one is its own name."""
    return F.regexp_replace(event_id, "^[^/]*/", "")


def pretty(event_id: Column) -> Column:
    return F.replace(event_name(event_id), F.lit("_"), F.lit(" "))


def first_forbidden(text: Column) -> Column:
    """The first label of FORBIDDEN whose pattern occurs; null if none."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in FORBIDDEN])


def fold(text: Column) -> Column:
    """Quotes, dashes and blanks as ASCII, lower case, single blanks."""
    plain = F.replace(F.translate(text, *FOLDED), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(F.lower(plain), r"[ \t\r\n]+", " "))


def evidence_in(evidence: Column, text: Column) -> Column:
    """Whether a quotation of at least two words occurs in a text, both folded."""
    quote = fold(evidence)
    return F.coalesce((F.size(words(quote)) >= 2) & F.contains(fold(text), quote), F.lit(False))


def _quotes_in(block: pa.Table):
    """For mapInArrow: (d, text) to (d, q), by one automaton of a block of quotes (q, t)."""
    ids, quotes = block["q"].combine_chunks(), block["t"].to_pylist()

    def run(batches):
        rows_of: dict[str, list[int]] = {}
        for n, t in enumerate(quotes):
            rows_of.setdefault(t, []).append(n)
        everywhere = rows_of.pop("", [])
        machine = ahocorasick.Automaton()
        for t, rows in rows_of.items():
            machine.add_word(t, rows)
        if rows_of:
            machine.make_automaton()
        for batch in batches:
            at, which = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hits = {rows[0]: rows for _, rows in machine.iter(text)} if rows_of else {}
                found = [n for rows in (everywhere, *hits.values()) for n in rows]
                at += [i] * len(found)
                which += found
            yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(at, pa.int64())), ids.take(pa.array(which, pa.int64()))], ["d", "q"])

    return run


def quoted(docs: DataFrame, doc: str, doc_text: str, quotes: DataFrame, quote: str, quote_text: str, most: int = 1 << 22) -> DataFrame:
    """(doc, quote): texts that contain a quote, both folded; every pair once per rows of them.

    Quotes are the small side: blocks of about `most` characters go to every task, where one automaton finds all of a
    block's quotes in one pass over each text, so texts are never shuffled. An empty quote is in every text; null texts
    and quotes are in none.
    """
    rows = quotes.select(F.col(quote).alias("q"), fold(F.col(quote_text)).alias("t")).where("t IS NOT NULL")
    blocks = max(1, -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // most))
    texts = docs.select(F.col(doc).alias("d"), fold(F.col(doc_text)).alias("text")).where("text IS NOT NULL")
    schema = T.StructType([T.StructField("d", docs.schema[doc].dataType), T.StructField("q", quotes.schema[quote].dataType)])
    block = lambda b: rows.where(F.pmod(F.xxhash64("q", "t"), F.lit(blocks)) == b).toArrow()
    found = reduce(DataFrame.unionByName, [texts.mapInArrow(_quotes_in(block(b)), schema) for b in range(blocks)])
    return found.select(F.col("d").alias(doc), F.col("q").alias(quote))


#: Fields in which a reply's object may hold the answer, in the order in which they are looked for.
ANSWER_FIELDS = ("answer", "choice", "option", "sound", "scene", "location")
PRESENCE_FIELDS = ("sound_present", "present", "sound", "answer")


def field_of(value: Column, names: tuple[str, ...]) -> Column:
    """The first of the named fields that a JSON object has, as text; anything else than an object as it is, a string unquoted."""
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    held = F.coalesce(*[F.when(F.array_contains(keys, n), F.coalesce(F.get_json_object(value, f"$.{n}"), F.lit(""))) for n in names])
    plain = F.when(F.trim(value).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    return F.coalesce(held, plain)


def presence_of(value: Column) -> Column:
    """Whether a reply's value says that a sound is there: true, yes or oui; false, no or non; null for anything else."""
    said = F.lower(F.trim(field_of(value, PRESENCE_FIELDS)))
    return F.when(said.isin("true", "yes", "oui"), True).when(said.isin("false", "no", "non"), False)


def reaction_of(value: Column) -> Column:
    """The reaction that a reply's value names exactly; null for anything else."""
    said = F.lower(F.trim(field_of(value, ("reaction",))))
    return F.when(said.isin(*REACTIONS), said)


def read_choice(reply: Column, options: Column) -> Column:
    """The option a reply names: equal but for case, else the only one it contains; else null."""
    said = F.lower(F.trim(reply))
    equal = F.filter(options, lambda o: F.lower(o) == said)
    held = F.filter(options, lambda o: F.contains(said, F.lower(o)))
    return F.when(F.coalesce(said, F.lit("")) == "", None).when(F.size(equal) > 0, F.get(equal, F.lit(0))).when(F.size(held) == 1, F.get(held, F.lit(0)))


def read_reaction(reply: Column) -> Column:
    """The only reaction word in a reply, else null."""
    found = F.filter(F.array(*[F.lit(r) for r in REACTIONS]), lambda r: F.regexp_count(F.lower(reply), F.concat(F.lit("(^|[^a-z])"), r, F.lit("($|[^a-z])"))) > 0)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def read_presence(reply: Column) -> Column:
    """True for yes or true, false for no or false, null for both or neither."""
    yes, no = (F.lower(reply).rlike(rf"(^|[^a-z])({w})($|[^a-z])") for w in ("yes|true", "no|false"))
    return F.when(yes != no, yes)


#: Words that a scenario's subject may have, and how much of a prompt's end is looked for in a reply.
LEAST_SUBJECT, MOST_SUBJECT, PROMPT_END = 4, 60, 60


def subject_fault(subject: Column) -> Column:
    """What is wrong with a generated subject; null if nothing is."""
    own = F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"[ \t\r\n]+", " "))
    n = F.size(words(own))
    return F.when(own == "", "empty subject").when(n < LEAST_SUBJECT, "subject too short").when(n > MOST_SUBJECT, "subject too long")


def after_prompt(raw: Column, prompt: Column) -> Column:
    """What a reply says behind the last time it repeats the prompt's end; all of it if it doesn't."""
    end = F.trim(F.regexp_replace(F.substring(F.coalesce(prompt, F.lit("")), -PROMPT_END, PROMPT_END), r"^\s+|\s+$", ""))
    behind = F.substr(raw, F.length(raw) - F.instr(F.reverse(raw), F.reverse(end)) + 2)
    return F.when((end != "") & F.contains(raw, end), F.regexp_replace(behind, r"^\s+", "")).otherwise(raw)


def strip_thinking(raw: Column) -> Column:
    """A model's reply without its thinking blocks, closed or not."""
    closed = F.regexp_replace(raw, r"(?is)<think(ing)?>.*?</think(ing)?>", " ")
    return F.trim(F.regexp_replace(closed, r"(?is)<think(ing)?>.*$", " "))


def repetitions(lower: Column) -> Column:
    """Alphabetic words of a text in lower case, how often the most frequent one occurs, and the most frequent run of three but the last."""

    def counts(text: str | None) -> tuple[int, int | None, int | None]:
        found = WORD.findall(text or "")
        runs = Counter(zip(found[:-1], found[1:-1], found[2:-1])) if len(found) > 3 else {}
        return len(found), max(Counter(found).values(), default=None), max(runs.values(), default=None)

    @F.pandas_udf("n_words int, top_word_count int, top_run_count int")
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=["n_words", "top_word_count", "top_run_count"]).astype("Int32")

    return counted(lower)


def degeneracy(df: DataFrame, text: str, most: int = 8) -> DataFrame:
    """`df` with n_words, top_word_count, top_run_count and reason, which tells looping texts; null for sound ones.

    Words are alphabetic. A run of three words counts in texts of more than twelve, the last one excepted; longer runs
    that repeat hold one of three that does. All is counted within the row, in Arrow batches, so nothing is shuffled.
    """
    said = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+", " "))
    dense = F.replace(said, F.lit(" "), F.lit(""))
    rows = df.withColumn("_r", repetitions(F.lower(F.coalesce(F.col(text), F.lit("")))))
    rows = rows.withColumns({c: F.col(f"_r.{c}") for c in ("n_words", "top_word_count", "top_run_count")})
    n, top = F.col("n_words"), F.col("top_word_count")
    without_first = F.replace(dense, F.substring(dense, 1, 1), F.lit(""))
    few = (F.length(dense) > 20) & (F.replace(without_first, F.substring(without_first, 1, 1), F.lit("")) == "")
    reason = (
        F.when(dense == "", "empty reply").when(few, "one or two characters").when(n == 0, "no alphabetic word")
        .when((top > most) & (top > n * 0.3), "a word repeats").when((n > 12) & (F.col("top_run_count") > most), "a run repeats")
    )
    return rows.withColumn("reason", reason).drop("_r")


def safe_ids(df: DataFrame, column: str, order: str, longest: int = 64) -> DataFrame:
    """`df` with safe_id: the column in [A-Za-z0-9_-] (other characters become -), cut; an empty one becomes id.

    Where several values collide, the first by `order` keeps its name, the others end in eight digits of their SHA-1.
    """
    plain = F.coalesce(F.nullif(F.substring(F.regexp_replace(F.col(column), "[^A-Za-z0-9_-]", "-"), 1, longest), F.lit("")), F.lit("id"))
    first = df.groupBy(plain.alias("_p")).agg(F.min_by(column, order).alias("_first"))
    marked = F.concat(F.substring(F.col("_p"), 1, longest - 9), F.lit("-"), F.substring(F.sha1(F.col(column).cast("binary")), 1, 8))
    rows = df.withColumn("_p", plain).join(first, "_p")
    return rows.withColumn("safe_id", F.when(F.col(column).eqNullSafe(F.col("_first")), F.col("_p")).otherwise(marked)).drop("_p", "_first")
