"""Character classes, folds and pattern tests over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns of the document format.
LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:[’']{LETTER}+)?"
FOLIO = r"^[^\p{L}\p{N}]*[0-9]{1,4}[^\p{L}\p{N}]*$"
OCR_WORD = rf"{LETTER}[0-9^<>|\\~]+{LETTER}"
GLUED = r"[a-zçğıöşü]{3,}[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}"
HYPHEN_BREAK = rf"{LETTER}{{2,}}- [a-zçğıöşü]{{2,}}"
BAD_CHARS = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{00AD}\x00-\x08\x0B\x0C\x0E-\x1F]"
LETTER_WORDS = ("a", "o", "e", "i", "I", "O", "A", "E", "y")
EDGE_MARKS = ".,;:!?\"'“”‘’()[]«»…-–—"
BULLET = r"^[•●○◦▪‣–\-*]\s+"
NUMBERED = r"^([0-9]{1,3}|[a-zA-Z]|[ivxlcdmIVXLCDM]{1,6})[.)]\s+"
LEADER_LINE = r"(?:[.…·•‧∙⋅_]\s*){4,}\s*[0-9]{1,4}\s*$"
TOC_TITLE = r"(?iu)^\s*(?:içindekiler|icindekiler|contents|table of contents|inhalt|inhaltsverzeichnis|sommaire|table des matières|índice|indice|sommario|المحتويات|فهرس)\s*(?:tablosu)?\s*$"
CAPTION = r"(?iu)^\s*(?:tablo|şekil|sekil|resim|grafik|çizelge|cizelge|figure|fig\.|table|chart|plate)\s*[0-9]{1,3}\s*[:.\-–—]"
DIVISION_WORDS = "bölüm|kısım|kitap|fasıl|chapter|part|book|section|kapitel|teil|abschnitt|chapitre|partie|capítulo|parte|capitolo|الفصل|الباب"
DIVISION_WORD = rf"(?iu)^\s*(?:{DIVISION_WORDS})(?![\p{{L}}\p{{N}}_])"
BARE_NUMBER = r"(?iu)^\s*([0-9]{1,3}|[ivxlcdm]{1,7})\s*[.)]?\s*$"
NUMBERED_TITLE = rf"(?iu)^\s*(?:(?:{DIVISION_WORDS})\s+)?([0-9]{{1,3}}|[ivxlcdm]{{1,7}})\s*[.):—–\-]\s*\S"
SECTION_NUMBER = r"^\s*([0-9]{1,3}(?:\.[0-9]{1,3})*)\.?\s*[^0-9]"
URL = r"(?i)^(https?://|www\.)|\.(com|org|net|io|co)\b"
OPENS_AS_QUOTE = r"""^\s*[«"“”'‘’]"""
BIBLIOGRAPHY_TITLE = r"(?iu)^\s*(?:[0-9]{1,3}(?:\.[0-9]{1,3})*\.?\s*)?(?:kaynak[çc]a|kaynaklar|yararlan[ıi]lan kaynaklar|bibliyografya|referanslar|references|bibliography|works cited|literature cited|sources|literatur|literaturverzeichnis|bibliographie|références|referencias|bibliografía|bibliografia|riferimenti bibliografici|المراجع|المصادر)\s*:?\s*$"
NUMBERED_ENTRY = r"^\s*(?:\[[0-9]{1,3}\]|\([0-9]{1,3}\)|[0-9]{1,3}[.)])\s+\S"
LINK_LINE = r"(?i)^\s*(?:https?://|www\.|doi\s*:|dx\.doi)"
ENDNOTE_HEADING = r"(?iu)^\s*(notes?|endnotes?|notes to (chapter|pages?).*|chapter notes|notlar|dipnotlar|sonnotlar|anmerkungen|notas)\s*$"
CHAPTER_SCOPE = r"(?iu)^\s*(?:notes\s+to\s+)?(?:chapter|bölüm|kapitel|chapitre)\s+([0-9ivxlc]+)\b.*$"
NOTE_ENTRY = r"^\s*([0-9]{1,4}|[*†‡§¶#]{1,3})[.)\]]?\s+(.+)$"
MARKER = r"^[\[({<]?\s*([0-9]{1,3}|[*†‡§¶#]{1,3})\s*[\])}>]?\s*[.:)]?$"
PAGE_NUMBER = r"""^[\-–—•·∙*.,:;'"\x{0060}´^~_|°‹›<>«»()\[\]\s]*[0-9][0-9\s]{0,5}[\-–—•·∙*.,:;'"\x{0060}´^~_|°‹›<>«»()\[\]\s]*$"""
FOLIO_HEAD = r"^\s*(?:[0-9]{1,4}\s*[|│•·]\s*\S.*|.*\S\s*[|│•·]\s*[0-9]{1,4})\s*$"
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
DIACRITICS = ("şŞğĞçÇöÖüÜıİâÂîÎûÛ", "ssggccoouuiiaaiiuu")
MARKED = "şŞğĞçÇöÖüÜâÂîÎûÛ"
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("Œ", "OE"), ("œ", "oe"), ("ﬓ", "մն"), ("ﬔ", "մե"))
RTL = r"[\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}]"
TERMINAL = ".!?…:;\"”»’"


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(text: Column) -> Column:
    """Lower case without the dotted-I hazard."""
    return F.lower(F.translate(text, "İI", "iı"))


def diacritic_key(text: Column) -> Column:
    return F.lower(F.translate(text, *DIACRITICS))


def marked_letters(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, MARKED, ""))


def head_key(text: Column) -> Column:
    """Key of a running head: its letters if four or more, else its characters with digit runs as #."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}]", "")
    return F.when(F.length(letters) >= 4, letters).otherwise(F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"[0-9]+", "#")))


def marker(text: Column) -> Column:
    """The bare identity of a note marker, null if the text is none."""
    found = F.regexp_extract(F.translate(squeezed(text), *SUPERSCRIPTS), MARKER, 1)
    return F.when(found != "", found)


def expand_ligatures(text: Column) -> Column:
    for one, many in LIGATURES:
        text = F.replace(text, F.lit(one), F.lit(many))
    return text


def recover_symbols(text: Column) -> Column:
    """Private-use code points of symbol fonts as the characters they stand for."""
    own = "".join(chr(0xF000 + c) for c in range(0x20, 0x7F)) + ""
    return F.translate(text, own, "".join(map(chr, range(0x20, 0x7F))) + "•")


def join_broken_lines(lines: Column) -> Column:
    """Lines of a paragraph as one text: end-of-line hyphens close before a lower-case letter."""

    def merge(a: Column, x: Column) -> Column:
        x = F.trim(x)
        return F.when(a == "", x).when(a.rlike(rf"{LETTER}[-\x{{00AD}}]$") & x.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, r"[-\x{00AD}]$", ""), x)).otherwise(F.concat(a, F.lit(" "), x))

    return F.regexp_replace(F.aggregate(lines, F.lit(""), merge), r"[ \t]{2,}", " ")


#: The deterministic repairs in their fixed order: kind, reason, repair. Spaces are only removed inside a line.
HYGIENE = (
    ("unicode_normalization", "typographic ligature spelled out", expand_ligatures),
    ("unicode_normalization", "text of a symbol font recovered", recover_symbols),
    ("punctuation_spacing", "third dot after a closing mark", lambda t: F.regexp_replace(t, r"([?!])\.\.(?![.…])", "$1...")),
    ("control_character", "control characters dropped", lambda t: F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")),
    ("punctuation_spacing", "space before a mark", lambda t: F.regexp_replace(t, r"(?<=[^\s.])[ \t]+([,;:!?])", "$1")),
    ("punctuation_spacing", "space before a full stop", lambda t: F.regexp_replace(t, r"(?<=[^\s.])[ \t]+\.(?!\s*\.)", ".")),
    ("punctuation_spacing", "no space behind a mark", lambda t: F.regexp_replace(t, rf"([,;:])(?={LETTER})", "$1 ")),
    ("repeated_punctuation", "mark repeated", lambda t: F.regexp_replace(t, r"([,;:!?])\1+", "$1")),
    ("punctuation_spacing", "space inside an opening quote", lambda t: F.regexp_replace(t, r"([“‘])[ \t]+(?=[\p{L}\p{N}])", "$1")),
    ("punctuation_spacing", "space inside a closing quote", lambda t: F.regexp_replace(t, r"(?<=[\p{L}\p{N}.,!?…])[ \t]+”(?=\s|$|[\p{L}\p{N}])", "”")),
)


def hygiene(text: Column) -> Column:
    """All deterministic repairs of a text."""
    for _, _, repair in HYGIENE:
        text = repair(text)
    return text


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def sentinel_free(text: Column) -> Column:
    """Text without the private-use marks of notes and emphasis."""
    return F.regexp_replace(text, r"[\x{E000}-\x{E005}]", "")


def roman(text: Column) -> Column:
    """The value of a roman or arabic numeral, null if it is neither."""
    upper = F.upper(text)
    digits = F.filter(F.split(upper, ""), lambda c: c != "")
    value = F.create_map(*[F.lit(x) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in kv])
    worth = F.transform(digits, lambda c: F.try_element_at(value, c))
    total = F.aggregate(F.transform(worth, lambda v, i: F.when(v < F.coalesce(F.get(worth, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return F.when(upper.rlike("^[0-9]+$"), upper.try_cast("int")).when(upper.rlike("^[IVXLCDM]+$"), total)


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    plain = F.translate(F.lower(F.translate(text, "İI", "ii")), "ışğçöüâîûáàäéèêëíïñóòôúùß", "isgcouaiuaaaeeeeiinooouus")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
