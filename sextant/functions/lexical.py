"""Scalar text functions as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.model import LANGUAGE_OF, lookup

# Word lists of the classifier and the tokenisers.
STOP_WORDS = "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through and or but not that this these those it its if then than so up out new all every how what where when why which who whom there here no nor just very also some any each both few more most other such only own same about".split()
PATH_EXTENSIONS = [".rs", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".c", ".cpp", ".h", ".hpp", ".rb", ".yaml", ".yml", ".toml", ".json", ".xml", ".html", ".css", ".scss", ".md"]
PLURAL_NOUNS = "implementations handlers providers routes guards migrations middlewares controllers services models types interfaces structures functions methods classes modules components endpoints callbacks listeners adapters converters validators serializers deserializers parsers renderers views schemas operations processors factories builders strategies plugins".split()
ABSTRACT_PREFIXES = ["how does ", "how do ", "how is ", "how are ", "how can ", "what controls ", "what determines ", "what drives ", "what governs ", "what manages ", "what orchestrates ", "what coordinates "]
ERROR_SIGNALS = ["error", "panic", "failed", "failure", "deadlock", "timeout", "crash", "exception", "abort", "refused", "overflow", "underflow", "segfault", "nil pointer", "null pointer", "stack overflow", "out of memory", "connection refused", "access denied", "permission denied"]
RELATION_PHRASES = ["what calls ", "who calls ", "what invokes ", "who invokes ", "callers of ", "callees of ", "what connects ", "what links ", "relationship between ", "dependents of ", "dependencies of "]
PATH_NATURAL_WORDS = "the a an is are how what where all every find get search".split()
SYMBOL_NATURAL_WORDS = "the a an is are was were for from into using before after during with without over under between through how what where when who why and or but not does do can in on at to of if all every each any by that this".split()
TEST_PATHS = ["/test", "/tests/", "/__tests__/", "/spec/", "_test.", "_spec.", ".test.", ".spec.", "test_", "/benches/", "/benchmark/"]
ENTRY_PATHS = ["/main.", "/index.", "/app.", "/server.", "/mod.", "/lib."]


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def split_identifier(name: Column) -> Column:
    """Words of a camelCase, snake_case or dotted name, in lower case, with one space between."""
    spaced = F.regexp_replace(name, "[^A-Za-z0-9]+", " ")
    spaced = F.regexp_replace(spaced, "([a-z][0-9]*)([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z0-9])([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(spaced), " +", " "))


def index_terms(text: Column) -> Column:
    """Distinct sorted terms of two characters or more: whitespace tokens and the words of split names, without stop words."""
    tokens = F.concat(F.split(F.lower(text), r"\s+"), F.split(split_identifier(text), " "))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))))


def extract_terms(text: Column) -> Column:
    """Terms of two bytes or more in order, repetitions kept: whitespace tokens, then the words of split names, without stop words."""
    tokens = F.concat(F.split(F.lower(text), r"\s+"), F.split(split_identifier(text), " "))
    return F.filter(tokens, lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOP_WORDS))


def is_question(text: Column) -> Column:
    """Three tokens or more, none of them code (an underscore in over four bytes, ::, two capitals), and less than half of three bytes or fewer."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    code = F.exists(tokens, lambda t: (F.contains(t, F.lit("_")) & (F.octet_length(t) > 4)) | F.contains(t, F.lit("::")) | t.rlike(r"\p{Lu}.*\p{Lu}"))
    short = F.size(F.filter(tokens, lambda t: F.octet_length(t) <= 3))
    return (F.size(tokens) >= 3) & ~code & (short / F.greatest(F.size(tokens), F.lit(1)) < 0.5)


def variants(term: Column) -> Column:
    """The term and what its plural, -ing, -ed, -tion and -ment endings leave, sorted."""
    w = F.lower(term)
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    ends = lambda s, least: F.endswith(w, F.lit(s)) & (n > least)
    plural = F.when(ends("ies", 4), F.concat(cut(3), F.lit("y"))).when(ends("es", 3), cut(2)).when(ends("s", 3), cut(1))
    more = [plural, F.when(ends("ing", 5), cut(3)), F.when(ends("ing", 5), F.concat(cut(3), F.lit("e"))), F.when(ends("ed", 4), cut(2)), F.when(ends("tion", 3), F.concat(cut(4), F.lit("te"))), F.when(ends("ment", 5), cut(4))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(term, *more))))


def language(path: Column) -> Column:
    return lookup(LANGUAGE_OF, F.lower(F.element_at(F.split(path, r"\."), -1)), "unknown")


def file_role(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(any_of(p, ["/test", "_test."]), "test file")
        .when(p.rlike(r"/(main\.rs|main\.ts|index\.ts|index\.js)$"), "entry point")
        .when(any_of(p, ["/src/lib", "/mod.rs"]), "library module")
        .when(any_of(p, ["/cli/", "cli.rs", "cli.ts"]), "cli command")
        .when(any_of(p, ["/bench/", "bench.rs"]), "benchmark")
    )


def module_name(path: Column) -> Column:
    stem = F.element_at(F.split(path, "/"), -1)
    return split_identifier(F.regexp_replace(stem, r"\.[^.]*$", ""))


def is_test_file(path: Column) -> Column:
    return any_of(F.lower(path), TEST_PATHS)


def is_entry_point(path: Column) -> Column:
    return any_of(F.lower(path), ENTRY_PATHS)


def is_code_token(t: Column) -> Column:
    return t.rlike("_|::|^.+[A-Z]|^[A-Za-z0-9]{1,2}$")


def query_family(query: Column) -> Column:
    """The strategy of a search query, by a cascade of rules."""
    lower = F.lower(query)
    tokens, original = F.filter(F.split(lower, r"\s+"), lambda t: t != ""), F.filter(F.split(query, r"\s+"), lambda t: t != "")
    n, first = F.size(tokens), F.get(tokens, F.lit(0))
    cross = (first.isin("all", "every", "each", "list", "show", "find") & (any_of(lower, PLURAL_NOUNS) | (n >= 3))) | any_of(lower, ["implementations of", "all the ", "list all"])
    relation = any_of(lower, RELATION_PHRASES) | (F.startswith(lower, F.lit("how does ")) & any_of(lower, [" connect ", " relate "]))
    slash = F.exists(tokens, lambda t: F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\")))
    path = any_of(lower, PATH_EXTENSIONS) | (slash & ((n == 1) | ~F.exists(tokens, lambda t: t.isin(PATH_NATURAL_WORDS))))
    symbol = F.forall(original, is_code_token) & ((n == 1) | ~F.exists(tokens, lambda t: t.isin(SYMBOL_NATURAL_WORDS)))
    abstract = reduce(lambda a, b: a | b, [F.startswith(lower, F.lit(p)) for p in ABSTRACT_PREFIXES])
    return (
        F.when(n == 0, "symbol-partial")
        .when(cross, "cross-cutting")
        .when(any_of(lower, ERROR_SIGNALS), "error-debug")
        .when(relation, "relationship")
        .when(path, "file-path")
        .when(symbol, "symbol-exact")
        .when(abstract, "nl-abstract")
        .otherwise("nl-descriptive")
    )


def numeric_literals(text: Column) -> Column:
    """Distinct sorted hexadecimal, decimal and fractional numbers that don't follow a letter, digit or underscore."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_.])(0[xX][0-9A-Fa-f]+|[0-9][0-9_]*(?:\.[0-9]+)?)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: normal_literal(F.replace(x, F.lit("_"), F.lit(""))))))


def normal_literal(x: Column) -> Column:
    """Hexadecimal in lower case; a whole number without its fraction."""
    value = x.try_cast("double")
    return F.when(x.rlike("^0[xX]"), F.lower(x)).when((value == F.floor(value)) & (F.abs(value) < 1e15), F.floor(value).cast("string")).otherwise(x)


def keeps_literal(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    hexa = F.startswith(x, F.lit("0x"))
    return (F.length(x) <= 20) & ~x.isin("", "0", "1") & ~(hexa & (F.length(x) <= 3)) & (digits != "") & ~((F.length(digits) < 2) & ~hexa & digits.isin("0", "1"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)

# Endings in the order of the rules, the least length of the word (0: any), and what takes their place.
ENDINGS = [("ies", 5, "i"), ("es", 5, None), ("ed", 5, ""), ("ing", 6, ""), ("tion", 0, "t"), ("sion", 0, "s"), ("ment", 0, ""), ("ness", 0, ""), ("able", 0, ""), ("ible", 0, ""), ("ful", 0, ""), ("less", 0, ""), ("ous", 0, ""), ("ive", 0, ""), ("er", 5, ""), ("ly", 5, ""), ("al", 5, "")]


def stem(word: Column) -> Column:
    """The word in lower case without its first matching ending; then at, bl, iz get an e, and y becomes i."""
    w = F.lower(word)
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    out = F.when(n < 4, w)
    for end, least, new in ENDINGS:
        left = cut(len(end))
        body = F.when(left.rlike("(ss|sh|ch|x|z)$"), F.concat(left, F.lit("e"))).otherwise(left) if new is None else F.concat(left, F.lit(new))
        out = out.when(F.endswith(w, F.lit(end)) & (n >= least), body)
    out = F.when(n < 4, w).otherwise(out.otherwise(w))
    with_e = F.when((n >= 4) & out.rlike("(at|bl|iz)$"), F.concat(out, F.lit("e"))).otherwise(out)
    y = (n >= 4) & with_e.rlike("[^ae]y$") & (F.length(with_e) >= 3)
    done = F.when(y, F.concat(F.substring(with_e, F.lit(1), F.length(with_e) - 1), F.lit("i"))).otherwise(with_e)
    return F.when(done == "", w).otherwise(done)


# Substrings of error literals, and kinds.
ERROR_LITERALS = ["error", "panic", "invalid", "timeout", "shutdown", "closed", "refused", "unauthorized", "forbidden", "not found", "already", "overflow", "deadlock"]
CONTAINERS = ["module", "namespace", "section", "import"]
DEFINITIONS = ["struct", "class", "enum", "interface", "trait"]
INDEXED_CONTAINERS = ["class", "struct", "interface", "trait", "enum", "module", "namespace"]


def is_public_api_file(path: Column) -> Column:
    return path.rlike(r"(?i)/(index|mod|lib|main|public)\.")


def is_dead_code_test_file(path: Column) -> Column:
    return path.rlike("(?i)test|spec")


def is_error_type(name: Column) -> Column:
    return name.rlike("(?i)error|exception|fault|err$|^err")


def is_error_literal(text: Column) -> Column:
    return any_of(F.lower(text), ERROR_LITERALS)


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller set that two arrays of distinct values have in common; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)
