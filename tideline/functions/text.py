"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: token and number patterns, question words, folding and transliteration tables ---
TOKEN = "[A-Za-zऀ-ॿ0-9]+"
NUMBER = r"\d+(?:\.\d+)?"
QUESTION_WORDS = ("kya", "kaise", "kyu", "kyun", "kab", "kaha", "kaun", "kitna")
FOLDS = {
    "chh": "c", "ch": "c", "kh": "k", "gh": "g", "jh": "j", "bh": "b", "dh": "d", "th": "t", "ph": "p", "sh": "s", "zh": "j",
    "gn": "n", "kn": "n", "ck": "k", "qu": "k", "aa": "a", "ee": "i", "ii": "i", "oo": "u", "uu": "u",
    "y": "i", "w": "v", "z": "j", "f": "p", "c": "k", "x": "ks",
}
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
    "क़": "q", "ख़": "kh", "ग़": "gh", "ज़": "z", "ड़": "r", "ढ़": "rh", "फ़": "f",
}
MATRAS = {
    "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "ॄ": "ri", "े": "e", "ै": "ai",
    "ो": "o", "ौ": "au", "ॉ": "o", "ॅ": "e", "ॆ": "e", "ॊ": "o", "ॢ": "li", "ॣ": "li",
}
VOWELS = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri", "ऌ": "li", "ए": "e", "ऐ": "ai",
    "ओ": "o", "औ": "au", "ऑ": "o", "ऍ": "e", "ऎ": "e", "ऒ": "o",
}
SIGNS = {"ं": "n", "ँ": "n", "ः": "h", "॰": " "}
VIRAMA = "्"
# --- end of the fixed values ---


def tokens(text: Column) -> Column:
    """Words of Latin letters, digits or Devanagari."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def is_question(text: Column) -> Column:
    """A question mark, or a question word among the lower-cased tokens."""
    words = F.array(*[F.lit(w) for w in QUESTION_WORDS])
    return F.coalesce(F.contains(text, F.lit("?")), F.lit(False)) | F.arrays_overlap(F.transform(tokens(text), F.lower), words)


def _mapped(parts: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(pairs, p), p)), "")


def romanize(text: Column) -> Column:
    """Devanagari in Latin letters: a consonant carries an 'a' unless a vowel sign or a virama follows
    or the word ends there; marks without a letter go. Other text stays as it is."""
    known = "".join([*CONSONANTS, *MATRAS, *VOWELS, *SIGNS, VIRAMA])
    kept = F.regexp_replace(text, f"[ऀ-ॿ&&[^{known}]]", "")
    own = F.regexp_replace(kept, f"([{''.join(CONSONANTS)}])(?![{''.join(MATRAS)}{VIRAMA}])", "$1\u0001")
    latin = _mapped(F.split(F.replace(own, F.lit(VIRAMA), F.lit("")), ""), CONSONANTS | MATRAS | VOWELS | SIGNS)
    vowels = F.regexp_replace(F.regexp_replace(latin, "\u0001(?=\\s|$)", ""), "\u0001", "a")
    return F.when(text.rlike("[ऀ-ॿ]"), vowels).otherwise(text)


def fold(text: Column) -> Column:
    """A spelling-tolerant key: lower case, letters only, one pass of longest-first replacements."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s]+", " ")
    known = "|".join(sorted(FOLDS, key=lambda k: (-len(k), k)))
    units = rf"{known}|(?:(?!{known})[\s\S]){{1,64}}"  # what stays as it is comes in runs
    folded = _mapped(F.regexp_extract_all(letters, F.lit(units), F.lit(0)), FOLDS)
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def skeleton(key: Column) -> Column:
    """A key without vowels and spaces."""
    return F.regexp_replace(key, r"[aeiou\s]", "")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether short's characters stand in long in order: what is left of long after each of them."""
    left = F.aggregate(F.split(short, ""), long, lambda rest, c: F.when(F.contains(rest, c), F.concat_ws("", F.substr(rest, F.position(c, rest) + 1))))
    return left.isNotNull()


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def snippet(text: Column, most: int = 150) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def safe_name(title: Column, most: int = 60) -> Column:
    """A file name: forbidden characters become underscores, dots and spaces at the ends go."""
    clean = F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", "")
    cut = F.when(F.length(clean) > most, F.regexp_replace(F.substring(clean, 1, most), r"[. ]+$", "")).otherwise(clean)
    return F.when(cut == "", "untitled").otherwise(cut)


def output_name(title: Column, index: Column, platform: Column, score: Column) -> Column:
    safe = F.trim(F.substring(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_"), 1, 50))
    return F.format_string("%s_clip%02d_%s_score%.2f.mp4", safe, index.cast("int"), platform, score)


def first_url(text: Column, host: str) -> Column:
    """The first URL of a host (a regular expression), https:// added where it has no scheme."""
    full = F.regexp_extract(text, rf"(?i)(https?://(?:www\.|m\.)?(?:{host})/\S+)", 1)
    bare = F.regexp_extract(text, rf"(?i)((?:www\.|m\.)?(?:{host})/\S+)", 1)
    return F.when(full != "", full).when(bare != "", F.concat(F.lit("https://"), bare))


def clock(seconds: Column) -> Column:
    """mm:ss."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def plain_caption(caption: Column) -> Column:
    """A caption without its tags."""
    return F.regexp_replace(caption, "<[^>]*>", "")


def escaped(text: Column) -> Column:
    """text for a caption with tags: the five characters that mark-up uses, by their entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text
