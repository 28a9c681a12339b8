"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these.
STOP_WORDS = (
    "а", "без", "бы", "был", "была", "были", "было", "в", "вам", "вас", "весь", "во", "вот", "все", "всего", "вы",
    "где", "да", "для", "до", "его", "ее", "если", "есть", "же", "за", "и", "из", "или", "им", "их", "к", "как", "ко",
    "ли", "мне", "мы", "на", "над", "не", "него", "нее", "нет", "ни", "но", "о", "об", "он", "она", "они", "оно", "от",
    "по", "под", "при", "с", "со", "так", "то", "у", "уже", "чем", "что", "чтобы", "это", "я",
)
SHORT_CODES = ("гк", "гпк", "кас", "нк", "опс", "пфр", "рф", "сз", "тк", "ук", "фз", "цб")
NOISE_WORDS = ("адрес", "дата", "тел", "телефон", "фио")
TOKEN = "[а-яёa-z0-9]+"
NUMBER = r"\d+(?:[.\-]\d+)*"
LEGAL_REFERENCE = rf"(?U)(?i)(?:\bст\.?\s*{NUMBER}\b|\bп\.?\s*{NUMBER}\b|\bч\.?\s*{NUMBER}\b|\b{NUMBER}\s*[- ]?\s*фз\b|\b\d+(?:[.\-]\d+)+\b)"
ARTICLE = r"(?U)(?i)(?:ст\.?|статья|статьи)\s*\d+(?:\.\d+)?(?:-\d+)?"
DATE = r"(?U)\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
MONEY = r"(?U)(?i)\b\d[\d\s]*(?:руб|рублей|р\.)\b"
#: White space as Python's str methods see it.
SPACES = r"[\s\x1c-\x1f\x85]"


@dataclass(frozen=True)
class TokenRules:
    """How texts become terms.  lemmatize needs a column function; without one terms stay as they are."""

    min_len: int = 3
    stop_words: bool = True
    lemmatize: bool = False
    preserve_legal_refs: bool = False
    legal_stop_words: bool = False
    add_bigrams: bool = False

    def with_(self, **changes) -> TokenRules:
        return replace(self, **changes)


PLAIN = TokenRules()
LEMMA = TokenRules(lemmatize=True, legal_stop_words=True)
LEGAL = TokenRules(min_len=2, lemmatize=True, preserve_legal_refs=True, legal_stop_words=True)
PHRASE = LEGAL.with_(add_bigrams=True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(sizes: Column) -> Column:
    """Where each of some parts begins that follow one another, from an array of their sizes.

    Sums run over blocks of about the root of their number, so that arrays grow by blocks and not by single parts: the
    work is the number of parts times its root at most.
    """

    def sums(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n.cast("long"))))

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, n: acc + n))
        return let(sums(totals), lambda upto: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(sums(b), 1, F.size(b)), lambda n: n + upto[i]))))

    def of_sizes(x: Column) -> Column:
        block = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        count = F.ceil(F.size(x) / block).cast("int")
        return let(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(x, i * block + 1, block)), of_blocks)

    return let(sizes, lambda x: F.when(F.size(x) > 0, of_sizes(x)).otherwise(F.array().cast("array<bigint>")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACES}+|{SPACES}+$", "")


def normalize_text(text: Column, replace_yo: bool = True) -> Column:
    """One spelling of spaces, quotes, dashes and (by default) the letter yo; lower case; null is empty."""
    before, after = " «»–—" + ("ёЁ" if replace_yo else ""), ' ""--' + ("еЕ" if replace_yo else "")
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), before, after)
    return F.lower(F.trim(F.regexp_replace(plain, rf"(?U){SPACES}+", " ")))


def raw_tokens(normalized: Column) -> Column:
    return F.transform(F.regexp_extract_all(normalized, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.translate(t, "ё", "е"))


def is_structured(token: Column) -> Column:
    return token.rlike(r"(?U)[\d_.\-]")


def legal_references(normalized: Column) -> Column:
    """References to articles, points, parts and laws, spelled one way: the kind, an underscore, the number."""

    def spelled(ref: Column) -> Column:
        tight = F.regexp_replace(F.translate(F.lower(ref), "ё", "е"), rf"(?U){SPACES}+", "")
        for kind in ("ст", "п", "ч"):
            tight = F.replace(tight, F.lit(f"{kind}."), F.lit(f"{kind}_"))
        for kind in ("ст", "п", "ч"):
            bare = tight.startswith(kind) & ~tight.startswith(f"{kind}_")
            tight = F.when(bare, F.concat(F.lit(f"{kind}_"), F.substr(tight, F.lit(len(kind) + 1)))).otherwise(tight)
        return F.replace(tight, F.lit("-фз"), F.lit("_фз"))

    found = F.regexp_extract_all(normalized, F.lit(LEGAL_REFERENCE), F.lit(0))
    return F.filter(F.transform(found, spelled), lambda t: t != "")


def bigrams(tokens: Column) -> Column:
    """Neighbours joined, where both are plain content words; positions are those of the list as it is."""
    plain = lambda t: ~is_structured(t) & ~t.isin(*STOP_WORDS, *NOISE_WORDS)
    pairs = F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.struct(t.alias("l"), tokens[i + 1].alias("r")))
    return F.transform(F.filter(pairs, lambda p: plain(p["l"]) & plain(p["r"])), lambda p: F.concat_ws("__", p["l"], p["r"]))


def lexical_tokens(text: Column, rules: TokenRules = PLAIN, lemma=None) -> Column:
    """Terms of a text.  In this order: tokens, legal references after them, length, stop words, lemmas, noise, bigrams."""
    tokens = let(normalize_text(text), lambda n: F.concat(raw_tokens(n), legal_references(n))) if rules.preserve_legal_refs else raw_tokens(normalize_text(text))
    long = lambda t: (F.length(t) >= rules.min_len) | t.isin(*SHORT_CODES) | is_structured(t)
    if rules.min_len > 1 and rules.stop_words:
        tokens = F.filter(tokens, lambda t: long(t) & ~t.isin(*STOP_WORDS))
    elif rules.min_len > 1:
        tokens = F.filter(tokens, long)
    elif rules.stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))
    if rules.lemmatize and lemma is not None:
        tokens = F.transform(tokens, lambda t: F.when(t.isin(*SHORT_CODES) | is_structured(t), t).otherwise(lemma(t)))
    if rules.legal_stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(*NOISE_WORDS))
    if rules.add_bigrams:
        tokens = let(tokens, lambda ts: F.concat(ts, bigrams(ts)))
    return tokens


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def char_grams(word: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside one word with a space on either side; sizes end with the first that covers the word."""

    def of_size(w: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, n))

    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return let(padded, lambda w: F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.greatest(F.lit(low), F.length(w)))), lambda n: of_size(w, n))))


def char_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"(?U){SPACES}+"), lambda w: w != "")


# --- features of court documents ------------------------------------------------------------------------------------


def document_kind(text: Column) -> Column:
    """Kind of document by the first 1200 characters, in upper case and without spaces (fixed values)."""
    head = F.replace(F.upper(F.substring(F.coalesce(text, F.lit("None")), 1, 1200)), F.lit(" "), F.lit(""))
    return (
        F.when(F.contains(head, F.lit("АПЕЛЛЯЦИОННОЕОПРЕДЕЛЕНИЕ")), "апелляционное определение")
        .when(F.contains(head, F.lit("ОПРЕДЕЛИЛ")), "определение")
        .when(F.contains(head, F.lit("РЕШИЛ")), "решение")
        .otherwise("судебный акт")
    )


def articles(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ARTICLE), F.lit(0)), lambda a: F.replace(F.lower(a), F.lit("статья"), F.lit("ст.")))
    return F.array_join(F.array_sort(F.array_distinct(found)), " ")


def mentions(text: Column, word: str) -> Column:
    return F.contains(F.upper(F.coalesce(text, F.lit(""))), F.lit(word)).cast("int")


def document_features(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [
        document_kind(text).alias("doc_kind"),
        articles(text).alias("articles"),
        F.regexp_count(t, F.lit(DATE)).alias("date_count"),
        F.regexp_count(t, F.lit(MONEY)).alias("money_count"),
        mentions(text, "УСТАНОВИЛ").alias("has_ustanovil"),
        mentions(text, "ОПРЕДЕЛИЛ").alias("has_opredelil"),
        mentions(text, "РЕШИЛ").alias("has_reshil"),
    ]


def field_aware_text(text: Column) -> Column:
    """The text and, after it, its features as words."""
    flags = [mentions(text, w).cast("string") for w in ("УСТАНОВИЛ", "ОПРЕДЕЛИЛ", "РЕШИЛ")]
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n\nтип_акта "), document_kind(text), F.lit(" статьи "), articles(text), F.lit(" признаки "), F.concat_ws(" ", *flags))


def pair_text(text: Column, limit: int) -> Column:
    """Text for a pair scorer: single spaces, at most limit characters."""
    return F.substring(strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U){SPACES}+", " ")), 1, limit)


def slug(name: str, max_len: int = 64) -> str:
    kept = "".join(c.lower() if c.isascii() and c.isalnum() else "_" for c in name)
    return "_".join(filter(None, kept.split("_")))[:max_len].strip("_")


def number_label(x: float) -> str:
    return f"{x}".replace(".", "p")
