"""String functions of the linkage pipeline as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Portuguese stopwords, without accents.
STOPWORDS = (
    "a ao aos aquela aquelas aquele aqueles aquilo as ate com como da das de dela delas dele deles depois do dos e ela elas ele eles em entre era eram essa essas esse esses esta "
    "estamos estao estas estava estavam este esteja estejam estes esteve estive estivemos estiver estiveram estivesse estivessem estou eu foi fomos for fora foram fosse fossem fui "
    "ha isso isto ja la lhe lhes lo mais mas me mesmo meu meus minha minhas muito na nao nas nem no nos nossa nossas nosso nossos num numa o os ou para pela pelas pelo pelos por "
    "qual quando que quem sao se seja sejam sem sera serao seu seus so sua suas tambem te tem temos tenho tera terao teu teus tinha tinham tive tivemos tu tua tuas um uma umas uns voce voces vos"
).split()

# Latin letters with marks and their bases, lower and upper case.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"

WORD = r"[\p{L}\p{N}_]+"
PT_TOKEN = r"\d+(?:[.,]\d+)+|\d+|\p{L}[\p{L}\p{N}_-]*"
BLANKS = r"[\s\x{00A0}]+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """White space runs become one space, ends are trimmed, null is empty."""
    return F.trim(F.regexp_replace(_text(c), BLANKS, " "))


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+|www\.\S+", " ")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def dedup_norm(c: Column) -> Column:
    """The key of exact text duplicates: without http links, blanks collapsed."""
    return clean_text(F.regexp_replace(_text(c), r"https?://\S+", ""))


def title_norm(c: Column) -> Column:
    return F.lower(dedup_norm(c))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def light_preprocess(c: Column) -> Column:
    return clean_text(strip_urls(_text(c)))


def heavy_tokens(c: Column) -> Column:
    """Lower-case accent-free tokens without markup, links and stopwords; numbers stay whole.

    Numbers and words are found by alternation, which makes place holders for numbers needless.
    """
    folded = fold_accents(F.lower(strip_urls(strip_tags(_text(c)))))
    found = F.regexp_extract_all(folded, F.lit(r"\d+(?:[.,]\d+)+|[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def heavy_preprocess(c: Column) -> Column:
    return F.array_join(heavy_tokens(c), " ")


def legacy_clean(c: Column) -> Column:
    """Without tags, lower case, ASCII punctuation deleted, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_tags(_text(c))), r"[!-/:-@\[-`{-~]", ""), BLANKS, " "))


def pt_tokens(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(PT_TOKEN), F.lit(0))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD), F.lit(0))


def adjacent(words: Column) -> Column:
    """Words, and each two that stand side by side with a blank between them."""
    first = lambda w: F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
    grams = lambda w: F.concat(w, F.zip_with(first(w), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))
    return F.element_at(F.transform(F.array(words), grams), 1)


def word_grams(c: Column) -> Column:
    """``adjacent`` of a text's words."""
    return adjacent(word_tokens(c))


def identity_norm(c: Column) -> Column:
    """The key of identical descriptions: lower, accent-free, no closing punctuation, blanks collapsed."""
    folded = F.trim(fold_accents(F.lower(_text(c))))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[.!?;:]+$", ""), BLANKS, " "))


def editals(c: Column) -> Column:
    """Distinct notice numbers such as 36/2018 in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(r"(?i)\b(?:n\.?|nº)?\s*([A-Z]{0,3}\d+/20[12]\d)\b"), F.lit(1)))


def edital_norm(c: Column) -> Column:
    """Leading zeros of the number before a single slash removed; all zeros become one."""
    parts = F.split(c, "/")
    head = F.ltrim(F.element_at(parts, 1), F.lit("0"))
    return F.when(F.size(parts) == 2, F.concat(F.when(head == "", F.lit("0")).otherwise(head), F.lit("/"), F.element_at(parts, 2))).otherwise(c)


def portal(url: Column) -> Column:
    """Host (with port) of a URL without ``www.``; sentinels where there is no link or no host."""
    host = F.regexp_replace(F.regexp_extract(_text(url), r"^[A-Za-z]+://([^/?#]*)", 1), r"www\.", "")
    return F.when(F.trim(_text(url)) == "", "(sem link)").when(host == "", "(sem dominio)").otherwise(host)


# Domain groups by portal.
PORTAL_GROUPS = {"ndmais.com.br": "ndmais_bulk", "nsctotal.com.br": "nsc_volume", "mpsc.mp.br": "official_minority", "tjsc.jus.br": "official_minority", "pc.sc.gov.br": "official_minority"}


def portal_group(c: Column, groups: dict[str, str] | None = None) -> Column:
    out = None
    for name, group in (PORTAL_GROUPS if groups is None else groups).items():
        out = F.when(c == name, group) if out is None else out.when(c == name, group)
    return out.otherwise("other")


# Substrings that mark a feature as about the subject, or about a portal's style.
SEMANTIC = "licitac irregularidade fraude fraudes operacao empresa contrato ex-prefeito compra respirador cpi prefeito tce corrupcao investigacao processo publico desvio propina superfaturamento criminoso tributario sonegacao peculato prevaricacao corrupto golpe estelionato malversacao advogado mpsc justica stf stj ministerio denuncia indiciamento inquerito mandado prisao condenacao pena furto roubo recurso pagamento prestador servico licitantes processual municipal estadual politica político vereador".split()
STYLED = ["assinatura", "redacao", "fale conosco", "editoria", "repórter", "publicidade", "publicadas", "copyright", "todos os direitos", "leia mais", "veja tambem", "compartilhe", "comente", "curta", "siga", "newsletter", "assine", "edicoes", "acesso", "facebook", "twitter", "instagram", "youtube", "whatsapp", "contato"]


def feature_class(c: Column, semantic: list[str] | None = None, styled: list[str] | None = None) -> Column:
    low = F.lower(c)
    has = lambda words: F.exists(F.lit(words), lambda w: F.contains(low, w))
    return F.when(has(SEMANTIC if semantic is None else semantic), "semantic_fraud").when(has(STYLED if styled is None else styled), "stylized_portal").otherwise("other")


def bias_level(a: Column, b: Column) -> Column:
    """LOW where both semantic shares reach 0.7, MEDIUM where one reaches 0.5, else HIGH."""
    return F.when((a >= 0.7) & (b >= 0.7), "LOW").when((a >= 0.5) | (b >= 0.5), "MEDIUM").otherwise("HIGH")


def page_url(template: Column, page: Column) -> Column:
    return F.replace(template, F.lit("{}"), page.cast("string"))


def absolute_url(base: Column, href: Column) -> Column:
    """A link without query and fragment, resolved against a site root."""
    bare = F.regexp_extract(href, r"^[^?#]*", 0)
    return F.when(F.startswith(bare, F.lit("/")), F.concat(F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*", 0), bare)).otherwise(bare)


def accepted_link(href: Column, prefixes: list[str], excludes: list[str]) -> Column:
    """No excluded substring, and starts with a prefix without being one."""
    out = F.exists(F.lit(prefixes), lambda p: F.startswith(href, p)) & ~href.isin(prefixes)
    return out if not excludes else out & ~F.exists(F.lit(excludes), lambda e: F.contains(href, e))


def title_and_text(title: Column, body: Column) -> Column:
    """Title, a space and text; a null of either is empty, so the space always stands."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def numbered_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n\n")


def answer_choice(answer: Column, n: Column) -> Column:
    """First whole number of an answer: 0 abstains, 1 to n chooses, else -1 (a failure)."""
    number = F.expr("CAST(NULL AS INT)")
    found = F.regexp_extract_all(_text(answer), F.lit(r"\b\d+\b"), F.lit(0))
    number = F.get(found, F.lit(0)).try_cast("int")
    return F.when(number.isNull() | (number > n), F.lit(-1)).otherwise(number)


def strip_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def null_literal_cleaner(c: Column) -> Column:
    return F.when(F.trim(c).isin("", "[]", "0", "-"), F.lit(None)).otherwise(c)


def presence_gate(present: Column, value: Column) -> Column:
    return F.when(F.trim(present.cast("string")).isin("1", "1.0"), value)


def char_ngrams(c: Column, n: int) -> Column:
    size = F.length(c)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def set_similarity(a: Column, b: Column, method: str) -> Column:
    """Jaccard, Dice or overlap coefficient of two arrays as sets; empty sides score 0."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    low = {"jaccard": F.size(F.array_union(a, b)), "dice": (F.size(a) + F.size(b)) / 2, "overlap": F.least(F.size(a), F.size(b))}[method]
    return F.when(low > 0, both / low).otherwise(0.0)


def comma_set(c: Column) -> Column:
    """Trimmed lower-case members of a comma list, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(_text(c), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def drop_bracket_items(items: Column) -> Column:
    return F.filter(items, lambda x: F.regexp_replace(x, r"[\[\] ]", "") != "")


def attribute_class(gold: Column, predicted: Column, strict: bool) -> Column:
    """TP, FP, FN or TN of a multi-valued attribute: gold a comma list or null, predicted an array."""
    want, got = comma_set(gold), F.array_distinct(F.transform(predicted, lambda x: F.lower(F.trim(x))))
    missing, extra = F.size(F.array_except(want, got)), F.size(F.array_except(got, want))
    wrong = F.when(F.size(got) == 0, "FN").otherwise("FP" if strict else "FN")
    right = (missing == 0) & (extra == 0) if strict else missing == 0
    return F.when(gold.isNull(), F.when(F.size(got) == 0, "TN").otherwise("FP")).when(right, "TP").otherwise(wrong if strict else F.lit("FN"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def json_strings(value: Column, key: str) -> Column:
    """A field of a JSON answer as an array of trimmed distinct strings: a scalar becomes one, anything else none."""
    raw = F.get_json_object(strip_fences(value), f"$.{key}")
    listed = F.from_json(raw, "array<string>")
    scalar = F.when(raw.isNull() | raw.startswith("{"), F.array().cast("array<string>")).otherwise(F.array(raw))
    items = F.when(raw.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(scalar)
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"^[\"']+|[\"']+$", ""))), lambda x: x.isNotNull() & (x != "")))
