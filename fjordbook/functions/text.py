"""Text as columns: tokens, stems, bigrams, sentences, chunks.

Everything here is a JVM-side expression over one row, so it runs inside a scan
with no shuffle and no Python.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to carry a signal.
STOP_WORDS = """
a an and are as at be but by can do does for from get had has have how i if in into is it its
many much must my no not of on or our should so some than that the their them then there these
they this to was we were what when where which who why will with you your
""".split()


WHITESPACE = " \t\r\n\f"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


# Norwegian words too common to search for (the published Snowball stop list).
NORWEGIAN_STOP_WORDS = """
alle at av bare begge ble blei bli blir blitt både båe da de deg dei deim deira deires dem den denne der dere deres
det dette di din disse ditt du dykk dykkar då eg ein eit eitt eller elles en enn er et ett etter for fordi fra før ha
hadde han hans har hennar henne hennes her hjå ho hoe honom hoss hossen hun hva hvem hver hvilke hvilken hvis hvor
hvordan hvorfor i ikke ikkje ingen ingi inkje inn inni ja jeg kan kom korleis korso kun kunne kva kvar kvarhelst kven
kvi kvifor man mange me med medan meg meget mellom men mi min mine mitt mot mykje ned no noe noen noka noko nokon nokor
nokre nå når og også om opp oss over på samme seg selv si sia sidan siden sin sine sitt sjøl skal skulle slik so som
somme somt så sånn til um upp ut uten var vart varte ved vere verte vi vil ville vore vors vort vår være vært å
""".split()

LANGUAGES = {"engelsk": STOP_WORDS, "norsk": NORWEGIAN_STOP_WORDS}


def _words(text: Column, language: str) -> Column:
    """Lower-case words of letters and digits, without single characters and stop words."""
    split = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda w: (F.length(w) > 1) & ~w.isin(LANGUAGES[language]))


def stems(text: Column, language: str = "engelsk") -> Column:
    """The stemmed words of ``text`` in order, as one string with spaces between.

    Endings are cut by scans over the joined words, which is much cheaper than
    a function call per word.
    """
    joined = F.array_join(_words(text, language), " ")
    return _norwegian(joined) if language == "norsk" else _english(joined)


def _english(spaced: Column) -> Column:
    """A plural ending goes first (``ies`` becomes ``y``), then one derivational ending.

    The latter leaves at least three letters; words of three letters stay. Each
    pattern looks back only where the ending occurs.
    """
    end = r"(?![^ ])"
    singular = F.regexp_replace(spaced, rf"ies(?<=[^ ]{{2}}ies){end}", "y")
    plural = r"es(?:(?<=[^ ]{2}ses)|(?<=(?:^| )sses))|s(?<=[^ ]{2}[^su ]s)"
    singular = F.regexp_replace(singular, rf"(?:{plural}){end}", "")
    return F.regexp_replace(singular, rf"(?:ion(?<=[^ ]{{3}}ion)|ing(?<=[^ ]{{3}}ing)|ed(?<=[^ ]{{3}}ed)|ly(?<=[^ ]{{3}}ly)){end}", "")


def spaced_words(text: Column) -> Column:
    """Lower-case words of letters and digits with single spaces between, stop words and all."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def stem_each(words: pa.Array, language: str = "engelsk") -> pa.Array:
    """The stem of each of an array of lower-case words; null for what :func:`stems` leaves out.

    For jobs that stem the different words of a batch once instead of each occurrence.
    """
    known = pc.and_(pc.greater(pc.utf8_length(words), 1), pc.invert(pc.is_in(words, value_set=pa.array(LANGUAGES[language]))))
    if language == "norsk":
        spaced = " ".join(words.to_pylist())
        for pattern, kept in _NORWEGIAN_STEPS:
            spaced = re.sub(pattern, kept.replace("$", "\\"), spaced)
        return pc.if_else(known, pa.array(spaced.split(" ")[:len(words)], pa.string()), pa.scalar(None, pa.string()))
    words = pc.replace_substring_regex(words, r"^(.{2,})ies$", r"\1y")
    sibilant = pc.match_substring_regex(words, r"^(?:.{2,}s|ss)es$")
    others = pc.replace_substring_regex(words, r"^(.{2,}[^su])s$", r"\1")
    words = pc.if_else(sibilant, pc.utf8_slice_codeunits(words, 0, -2), others)
    words = pc.replace_substring_regex(words, r"^(.{3,})(?:ion|ing|ed|ly)$", r"\1")
    return pc.if_else(known, words, pa.scalar(None, words.type))


# The endings of the published Snowball stemmer for Norwegian, by step.
_INFLECTIONS = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()
_DERIVATIONS = "leg eleg ig eig lig elig els lov elov slov hetslov".split()


def _norwegian_steps() -> list[tuple[str, str]]:
    """The published Norwegian stemmer: inflections, then ``dt``/``vt``, then derivations, as patterns over joined words.

    An ending counts only after the word's first vowel-consonant pair and at
    least three letters in. The stem is matched as short as possible, which
    makes the ending the longest that applies.
    """
    vowels = "aeiouyæåø"
    head = rf"(?<![^ ])([^{vowels} ]*[{vowels}]+[^{vowels} ][^ ]*?)(?<=[^ ]{{3}})"
    end = r"(?![^ ])"
    genitive = rf"s(?:(?<=[bcdfghjlmnoprtvyz]s)|(?<=[^{vowels} ]ks))"
    return [
        (rf"{head}(?:(er)te?|(?:{'|'.join(_INFLECTIONS)})|{genitive}){end}", "$1$2"),
        (rf"{head}([dv])t{end}", "$1$2"),
        (rf"{head}(?:{'|'.join(_DERIVATIONS)}){end}", "$1"),
    ]


_NORWEGIAN_STEPS = _norwegian_steps()


def _norwegian(spaced: Column) -> Column:
    for pattern, kept in _NORWEGIAN_STEPS:
        spaced = F.regexp_replace(spaced, pattern, kept)
    return spaced


def _listed(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def tokens(text: Column, language: str = "engelsk") -> Column:
    """Stemmed words of ``text`` in order, without stop words."""
    return _listed(stems(text, language))


def bigrams(text: Column) -> Column:
    """Adjacent pairs ``a_b`` of the tokens of ``text``."""
    pairs = F.regexp_replace(stems(text), r"([^ ]+) (?=([^ ]+))", "$1_$2 ")
    return _listed(F.regexp_replace(pairs, r"[^ ]+$", ""))


def terms(text: Column) -> Column:
    """The tokens of ``text``, each followed by the bigram it starts."""
    return _listed(F.regexp_replace(stems(text), r"([^ ]+) (?=([^ ]+))", "$1 $1_$2 "))


def sentences(text: Column) -> Column:
    """Quotable sentences: split after ``.!?`` and at newlines, longer than 20 characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip)
    return F.filter(parts, lambda s: F.length(s) > 20)


def windows(text: Column, cap: int = 900, overlap: int = 100) -> Column:
    """``text`` cut into pieces of at most ``cap`` characters that overlap a little."""
    step = cap - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(cap)))


def sections(markdown: Column) -> Column:
    """Sections of a document as ``(heading, body)``, split at its ``##`` headings.

    Text before the first heading is a section with an empty heading.
    """
    parts = F.split(markdown, r"(?m)^## +")

    def section(part: Column, index: Column) -> Column:
        headed = index > 0
        return F.struct(
            F.when(headed, strip(F.split_part(part, F.lit("\n"), F.lit(1)))).otherwise("").alias("heading"),
            strip(F.when(headed, F.regexp_replace(part, r"^[^\n]*\n?", "")).otherwise(part)).alias("body"),
        )

    return F.filter(F.transform(parts, section), lambda s: F.length(s["body"]) > 0)
