"""Technology tags of a text by a curated dictionary."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid.functions.text import bind


@dataclass(frozen=True)
class Alias:
    """One way a tag may be written.

    kind ``word``: letters and digits only -> whole word in any case; with
    symbols or blanks -> substring in any case. kind ``cap``: whole word
    written Xxx or XXX. ``not_after``: a character that must not precede the
    word. ``not_before``: a word that must not follow (after blanks or dashes).
    """

    tag: str
    alias: str
    kind: str = "word"
    not_after: str | None = None
    not_before: str | None = None


def _words(tag: str, *aliases: str) -> list[Alias]:
    return [Alias(tag, a) for a in aliases]


# The curated dictionary.
DEFAULT_DICTIONARY: tuple[Alias, ...] = (
    Alias("Go", "go", "cap"), *_words("Go", "golang"),
    *_words("JavaScript", "javascript"), Alias("JavaScript", "js", not_after="."),
    *_words("TypeScript", "typescript"),
    *_words("Python", "python"),
    *_words("Java", "java"),
    *_words("PHP", "php"),
    *_words("Ruby", "ruby"),
    *_words("Kotlin", "kotlin"),
    Alias("Swift", "swift", "cap"),
    Alias("Rust", "rust", "cap"),
    *_words("Dart", "dart"),
    *_words("C++", "c++"),
    *_words("C#", "c#"),
    Alias("React", "react", "cap", not_before="native"), *_words("React", "react.js", "reactjs"),
    *_words("React Native", "react native", "react-native"),
    *_words("Vue", "vue", "vue.js", "vuejs"),
    *_words("Angular", "angular"),
    *_words("Svelte", "svelte"),
    *_words("Next.js", "next.js", "nextjs"),
    *_words("Node.js", "node.js", "nodejs"),
    Alias("Express", "express", "cap"), *_words("Express", "express.js", "expressjs"),
    *_words("Django", "django"),
    *_words("Flask", "flask"),
    *_words("Laravel", "laravel"),
    Alias("Spring", "spring", "cap"), *_words("Spring", "spring boot", "springboot"),
    *_words("Rails", "rails", "ruby on rails"),
    *_words("FastAPI", "fastapi", "fast api"),
    *_words(".NET", ".net", "dotnet", "asp.net"),
    *_words("Flutter", "flutter"),
    *_words("Android", "android"),
    *_words("iOS", "ios"),
    *_words("PostgreSQL", "postgresql", "postgres"),
    *_words("MySQL", "mysql"),
    *_words("MongoDB", "mongodb", "mongo"),
    *_words("Redis", "redis"),
    *_words("SQLite", "sqlite"),
    *_words("SQL Server", "sql server", "mssql"),
    *_words("Docker", "docker"),
    *_words("Kubernetes", "kubernetes", "k8s"),
    *_words("AWS", "aws"),
    *_words("GCP", "gcp", "google cloud"),
    *_words("Azure", "azure"),
    *_words("Terraform", "terraform"),
    *_words("Jenkins", "jenkins"),
    *_words("Ansible", "ansible"),
    *_words("Prometheus", "prometheus"),
    *_words("Grafana", "grafana"),
    *_words("Nginx", "nginx"),
    *_words("GitLab", "gitlab"),
    *_words("GitHub Actions", "github actions"),
    *_words("Elasticsearch", "elasticsearch", "elastic search"),
    *_words("Helm", "helm"),
    *_words("VMware", "vmware"),
    *_words("Hyper-V", "hyper-v", "hyperv"),
    *_words("GraphQL", "graphql"),
    *_words("RabbitMQ", "rabbitmq"),
    *_words("Kafka", "kafka"),
    *_words("Git", "git"),
)


def _spellings(alias: Alias) -> tuple[str, ...]:
    if alias.kind == "cap":
        a = alias.alias
        return (a[:1].upper() + a[1:].lower(), a.upper())
    return (alias.alias.lower(),)


def _plain(text: str) -> bool:
    return re.fullmatch(r"[0-9A-Za-z]+", text) is not None


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _any_word(words) -> str:
    """A pattern of any of the whole words; words with the same first character share its test."""
    by_first: dict[str, list[str]] = defaultdict(list)
    for word in sorted(words):
        by_first[word[0]].append(word[1:])
    arms = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())
    return f"(?<![0-9a-z_])(?:{arms})(?![0-9a-z_])"


def _by_token(lowered: Column, tags_of: dict[str, set[str]]) -> Column:
    """Tags of the whole words of a text that are dictionary words, found in one pass."""
    hits = F.array_distinct(F.regexp_extract_all(lowered, F.lit(_any_word(tags_of)), F.lit(0)))
    table = F.create_map(*[x for word, tags in tags_of.items()
                           for x in (F.lit(word), _strings(sorted(tags)))])
    return F.flatten(F.transform(hits, lambda hit: F.element_at(table, hit)))


def _substring(alias: Alias, text: Column, lowered: Column) -> Column:
    return F.contains(lowered, F.lit(alias.alias.lower()))


def _guarded(alias: Alias, text: Column, lowered: Column) -> Column:
    """A word with conditions; the regex runs only if the word occurs at all."""
    subject = text if alias.kind == "cap" else lowered
    present = reduce(lambda a, b: a | b, [F.contains(subject, F.lit(s)) for s in _spellings(alias)])
    spelled = "|".join(re.escape(s) for s in _spellings(alias))
    before = "0-9A-Za-z_" + (re.escape(alias.not_after) if alias.not_after else "")
    after = "(?![0-9A-Za-z_])"
    if alias.not_before:
        after += (r"(?!(?i:[\t\n\f\r -]*" + re.escape(alias.not_before)
                  + "(?![0-9A-Za-z_])))")
    return present & F.rlike(subject, F.lit(f"(?<![{before}])(?:{spelled}){after}"))


def text_tags(title: Column, description: Column,
              dictionary: tuple[Alias, ...] = DEFAULT_DICTIONARY) -> Column:
    """Sorted tags of title and description; empty array if none.

    A row is tagged where it lies, without explode, join or shuffle: whole-word
    aliases are found by one pattern, substring aliases are ``contains``, and the few conditional
    aliases run their regex only on rows that hold the word at all.
    """
    words: dict[str, set[str]] = defaultdict(set)
    tests: dict[str, list] = defaultdict(list)
    for entry in dictionary:
        if entry.kind == "cap" or entry.not_after or entry.not_before:
            tests[entry.tag].append(partial(_guarded, entry))
        elif _plain(entry.alias):
            words[entry.alias.lower()].add(entry.tag)
        else:
            tests[entry.tag].append(partial(_substring, entry))

    def found(text: Column, lowered: Column) -> Column:
        parts = [F.array().cast("array<string>")]
        if words:
            parts.append(_by_token(lowered, words))
        if tests:
            fired = [F.when(reduce(lambda a, b: a | b, [t(text, lowered) for t in any_of]), F.lit(tag))
                     for tag, any_of in tests.items()]
            parts.append(F.array_compact(F.array(*fired)))
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    both = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))
    return bind(both, lambda text: bind(F.lower(text), lambda lowered: found(text, lowered)))
