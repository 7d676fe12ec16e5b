"""Delivery tags in spoken texts, as Spark expressions: cleaning, shouting, and tags for vocal events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import END, START, event_name

#: Words that only weaken a tag, tell the volume, or tell a manner that no voice performs.
WEAK = ("slightly", "slight", "a bit", "a little", "a touch", "somewhat", "faintly", "faint", "mildly", "mild", "subtly", "subtle", "barely", "lightly", "vaguely", "marginally", "half", "sort of", "kind of")
VOLUME = ("raising voice", "raised voice", "raises voice", "voice raised", "shouting", "shouts", "shouted", "yelling", "yells", "yelled", "loudly", "louder", "loud", "booming", "projecting", "calling out", "over the noise", "at volume")
MANNER = ("again", "back to normal", "as before", "once more", "softer", "warmer", "quieter", "flatter", "gentler", "slower", "warming", "refocusing", "softening", "steadying", "flat", "clipped", "curt", "brisk", "unbothered", "patient", "careful", "detached")
#: Words of which alone a tag may not consist.
FUNCTION_WORDS = tuple("a an the to it its of in on at for with and or but as so then now is was be been that this these those there here up out back down off over all one own more less very quite still just about into from".split())
#: Tags of sounds that a voice makes, and of others.
VOCAL = {
    "cough": "[coughs]", "coughing": "[coughs]", "sneeze": "[sneezes]", "sneezing": "[sneezes]", "laugh": "[laughs]", "laughter": "[laughs]", "laughing": "[laughs]", "chuckle": "[chuckles]", "giggle": "[giggles]",
    "sigh": "[sighs]", "sighing": "[sighs]", "gasp": "[gasps]", "groan": "[groans]", "yawn": "[yawns]", "sniff": "[sniffs]", "sniffle": "[sniffs]", "snort": "[snorts]", "hiccup": "[hiccups]",
    "throat": "[clears throat]", "clearing": "[clears throat]", "clear": "[clears throat]", "cry": "[crying]", "crying": "[crying]", "sob": "[crying]", "gulp": "[gulps]", "swallow": "[swallows]", "whistle": "[whistles]", "burp": "[burps]",
}
EFFECTS = {"gunshot": "[gunshot]", "gun": "[gunshot]", "explosion": "[explosion]", "applause": "[applause]", "clap": "[clapping]", "clapping": "[clapping]"}


def _any(phrases: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(p.replace(" ", r"\s+") for p in phrases) + r")\b"


def clean_tag(inner: Column) -> Column:
    """What a tag says without weakening words, volume and manner; empty if only function words are left."""
    out = inner
    for phrases in (WEAK, VOLUME, MANNER):
        out = F.regexp_replace(out, _any(phrases), " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ ,;]+|[ ,;]+$", "")
    out = F.regexp_replace(out, r"\s*,\s*", ", ")
    letters = F.regexp_extract_all(F.lower(out), F.lit("[a-z']+"), 0)
    return F.when((F.size(letters) > 0) & F.forall(letters, lambda w: w.isin(*FUNCTION_WORDS)), "").otherwise(out)


def is_volume(inner: Column) -> Column:
    return inner.rlike(_any(VOLUME))


def shouted(run: Column) -> Column:
    """A text with its first sentence in capitals, a full stop at its end turned into an exclamation mark."""
    sentence = F.regexp_extract(run, r"(?s)^(\s*[^.!?]*[.!?]?)", 1)
    rest = F.substr(run, F.length(sentence) + 1)
    return F.concat(F.upper(F.regexp_replace(sentence, r"\.$", "!")), rest)


def strengthened(text: Column) -> Column:
    """A spoken text whose tags are cleaned and whose sentence after a volume tag is shouted; unchanged where that changes nothing."""
    pattern = r"\[([^\]]*)\]"
    runs, inner = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 1)

    def behind(tag: Column, i: Column) -> Column:
        own, run = clean_tag(tag), F.get(runs, i + 1)
        return F.concat(F.when(own != "", F.concat(F.lit("["), own, F.lit("]"))).otherwise(""), F.when(is_volume(tag), shouted(run)).otherwise(run))

    joined = F.concat(F.get(runs, F.lit(0)), F.array_join(F.transform(inner, behind), ""))
    return F.when(joined == text, text).otherwise(F.trim(F.regexp_replace(joined, r"[ \t]{2,}", " ")))


def event_tag(event_id: Column, effects: bool = False, extra: dict[str, str] | None = None) -> Column:
    """The tag by which a voice can perform an event; null if it can't.

    The id itself counts first, then in lower case, then its leaf; last the leaf's words, if all of them are known, by the first.
    """
    known = VOCAL | (EFFECTS if effects else {}) | (extra or {})
    listed = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    single = {k: v for k, v in known.items() if "/" not in k and " " not in k}
    leaf = F.lower(event_name(event_id))
    parts = F.filter(F.split(leaf, r"[_\-\s]+"), lambda w: w != "")
    composed = F.when((F.size(parts) > 0) & F.forall(parts, lambda w: w.isin(*single)), F.try_element_at(listed, F.get(parts, F.lit(0))))
    found = F.coalesce(F.try_element_at(listed, event_id), F.try_element_at(listed, F.lower(event_id)), F.try_element_at(listed, leaf), composed)
    return F.when(event_id != "", found)
