"""Quality rules, line first: bad lines go, and a document that loses too much text goes with them. DataFrame only.

Everything is computed inside the document's own row with array functions, so nothing is shuffled and the size of a
source or of a group of copies does not matter. Repeated three-word windows are found by sorting (hash, position), so a
text of n words costs n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Line rules; the patterns mean the same to Java and to RE2.
#: Junk punctuation: no letter or digit at all.
NO_LETTER = r"^[^\p{L}\p{N}]*$"
#: A sign at the end of a word that prose has not.
SIGN_WORD = r"[#*$%&|<>~^=_]$"
#: Signs of a sentence; a line of several words without any is a list or a menu.
SENTENCE = r"[.,;:!?]"
#: Separators that part the entries of a navigation bar.
SEPARATOR = r"^(\||>|»|•|·|/|::|-)$"
#: A character that SIGN_WORD or SEPARATOR needs.
ANY_SIGN = r"[#*$%&|<>~^=_»•·/:-]"
# English, Spanish, French and German.
_MENU = (
    "home|menu|log ?in|log ?out|sign (in|up)|next|previous|back to top|read more|share|contact( us)?|about( us)?|search|skip to content",
    "inicio|menú|iniciar sesión|cerrar sesión|registrarse|siguiente|anterior|volver arriba|leer más|compartir|contacto|acerca de|buscar|saltar al contenido",
    "accueil|connexion|déconnexion|s'inscrire|suivant|précédent|haut de page|lire la suite|partager|contactez-nous|à propos|rechercher|aller au contenu",
    "startseite|menü|anmelden|abmelden|registrieren|weiter|zurück|nach oben|mehr lesen|weiterlesen|teilen|kontakt|über uns|suche|zum inhalt springen",
)
_BOILERPLATE = (
    r"all rights reserved|licensed under|copyright \(c\)|©|terms of (use|service)|privacy policy|cookie policy|uses? cookies|subscribe to our|click here|enable javascript",
    "todos los derechos reservados|bajo la licencia|condiciones de uso|política de (privacidad|cookies)|utiliza(mos)? cookies|suscríbete|haz clic aquí|activa javascript",
    "tous droits réservés|sous licence|conditions d'utilisation|politique de (confidentialité|cookies)|utilise(ns|ons)? des cookies|abonnez-vous|cliquez ici|activez javascript",
    "alle rechte vorbehalten|lizenziert unter|nutzungsbedingungen|datenschutz(erklärung|richtlinie)|verwende(n|t) cookies|abonnieren sie|klicken sie hier|javascript aktivieren",
)


def _either_case(patterns: tuple[str, ...]) -> str:
    """One alternation; letters beyond ASCII are given in both cases, since Java folds ASCII only."""
    return "".join(f"[{c}{c.upper()}]" if c > "\x7f" and len(c.upper()) == 1 and c != c.upper() else c for c in "|".join(patterns))


MENU = rf"(?i)^({_either_case(_MENU)})[\s.:>»]*$"
BOILERPLATE = rf"(?i)({_either_case(_BOILERPLATE)})"


def _in_words(line: Column) -> Column:
    return F.filter(F.split(line, SPACE, -1), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """Whether a punctuation, navigation or boilerplate rule removes a line that has a word."""
    words = _in_words(line)
    n = F.size(words)
    signs = F.size(F.filter(words, lambda w: w.rlike(SIGN_WORD)))
    separators = F.size(F.filter(words, lambda w: w.rlike(SEPARATOR)))
    # Words are looked at one by one only where the line has a sign at all, which prose seldom has.
    signed = F.when(line.rlike(ANY_SIGN), (signs * 2 > n) | (separators >= 3) & (separators * 4 >= n)).otherwise(False)
    punctuation = line.rlike(NO_LETTER) | ~line.rlike(SENTENCE) & (n >= 4)
    return punctuation | signed | line.rlike(MENU) | line.rlike(BOILERPLATE)


def quality(docs: DataFrame, most_lost: float = 0.5, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Counts and verdicts for each row of ``docs``, and the text that is left.

    Args:
        docs: has ``doc_id`` and ``text``; other columns are ignored. A null text has no words.
        most_lost: a document is rejected if the failing lines hold a larger share of its word characters.
        min_words, most_repeated: the base rule fails a document with fewer words, or with a larger percentage of
            words in repeated three-word windows.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept and
    clean_text (the lines that pass, joined by a line feed). Repeated rows are judged alike, each on its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("t"), F.filter(F.split(text, SPACE, -1), lambda w: w != "").alias("w"), F.split(text, "\n", -1).alias("lines"))
    d = d.withColumn("worded", F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n", F.size("w"))
    windows = "if(n < 3, array(), sort_array(transform(sequence(0, n - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i))))"
    d = d.withColumn("g", F.expr(windows))
    pairs = "zip_with(slice(g, 1, size(g) - 1), slice(g, 2, size(g) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), null))"
    d = d.withColumn("r", F.expr(f"if(n < 4, array(), sort_array(array_distinct(flatten(filter({pairs}, x -> x is not null)))))"))
    # A repeated window covers three words, or as many as lie before the next one.
    covered = "if(size(r) = 0, 0, 3 + aggregate(zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) -> least(3, b - a)), 0, (s, x) -> s + x))"
    d = d.withColumn("failing", F.transform("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x)))
    lost = "aggregate(zip_with(lines, failing, (x, f) -> if(f, length(regexp_replace(x, '[\\\\x20\\\\x09-\\\\x0D]+', '')), 0)), 0, (s, x) -> s + x)"
    d = d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.expr(lost).cast("long").alias("lost_chars"),
        F.expr("array_join(transform(filter(arrays_zip(lines, failing), x -> not x.failing), x -> x.lines), '\n')").alias("clean_text"),
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return d.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(most_lost) * F.col("word_chars")))
