"""URL filter: host and path rules first, then a weighted URL vocabulary.

An Aho-Corasick automaton finds every vocabulary term in the lower-cased url, its
percent escapes decoded, in one pass. A hit counts if it is a whole word of the url (no
letter or digit on either side). One strict term rejects; soft terms reject when several
distinct ones are found and their weights reach a threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default vocabulary. Strict terms decide alone; soft terms
# have a weight and add up.
STRICT_TERMS = [
    "porn", "porno", "pornstar", "xxx", "hentai", "camgirls", "milf", "escorts", "upskirt", "sexcam",
    "casino", "sportsbook", "viagra", "cialis", "tramadol", "warez", "keygen",
]
# 2: seldom met elsewhere; 1: ordinary words that spam uses a lot.
SOFT_TERMS = {
    "adult": 2, "sex": 2, "sexy": 2, "nude": 2, "naked": 2, "erotic": 2, "fetish": 2, "webcam": 2, "escort": 2,
    "poker": 2, "slots": 2, "roulette": 2, "jackpot": 2, "betting": 2, "gambling": 2, "torrent": 2, "cracked": 2,
    "payday": 2, "pharmacy": 2,
    "dating": 1, "singles": 1, "hot": 1, "girls": 1, "bet": 1, "odds": 1, "bonus": 1, "pills": 1, "crack": 1,
    "loan": 1, "loans": 1, "credit": 1, "free": 1, "cheap": 1, "win": 1, "download": 1, "serial": 1, "discount": 1,
}
# Soft terms reject from this weight on, if there are so many different ones.
SOFT_THRESHOLD = 3
SOFT_DISTINCT = 2

# The default rules, (host/path prefix, verdict).
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the url is null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _by_host(rules) -> dict[str, list[tuple[str, str, str]]]:
    """host -> [(path prefix, rule, verdict)], longest prefix first."""
    found: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        found.setdefault(host, []).append((slash + path, rule, verdict))
    for entries in found.values():
        entries.sort(key=lambda e: (-len(e[0]), e[2] != "block"))
    return found


def _rule_for(host: str, path: str, by_host: dict) -> tuple[str, str] | None:
    """The longest rule that fits; of equally long ones that with the longer
    host, then a blocking one."""
    best = None
    at = 0
    while host and at >= 0:
        suffix = host[at:]
        for prefix, rule, verdict in by_host.get(suffix, ()):
            if path.startswith(prefix):
                rank = (len(rule), len(suffix))
                if best is None or rank > best[0]:
                    best = (rank, rule, verdict)
                break
        dot = host.find(".", at)
        at = dot + 1 if dot >= 0 else -1
    return best and (best[1], best[2])


def _automaton(strict, soft) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term, weight in soft.items():
        machine.add_word(term.lower(), (term.lower(), float(weight)))
    for term in strict:
        machine.add_word(term.lower(), (term.lower(), None))
    machine.make_automaton()
    return machine


def _hits(url: str, machine) -> tuple[set, dict]:
    """Distinct strict terms, and soft terms with their weights, found as whole words."""
    strict, soft, n = set(), {}, len(url)
    for end, (term, weight) in machine.iter(url):
        before = end - len(term)
        if (before >= 0 and _is_word(url[before])) or (end + 1 < n and _is_word(url[end + 1])):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return strict, soft


def _plain(url: str) -> str:
    """The url in lower case (A-Z only), escaped letters and digits decoded once,
    any other escape a blank."""
    return ESCAPE.sub(_unescaped, url.translate(ASCII_LOWER))


def _unescaped(escape: re.Match) -> str:
    ch = chr(int(escape.group(1), 16)).translate(ASCII_LOWER)
    return ch if _is_word(ch) else " "


def _is_word(ch: str) -> bool:
    return "a" <= ch <= "z" or "0" <= ch <= "9"


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules=RULES,
    strict=STRICT_TERMS,
    soft=SOFT_TERMS,
    soft_threshold: float = SOFT_THRESHOLD,
    soft_distinct: int = SOFT_DISTINCT,
) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule``, ``verdict``, ``strict_terms``
    and ``soft_terms`` (distinct terms found, sorted, joined by commas).

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule wins (ties: longer host, then block). Without a rule the
    vocabulary decides: block on one strict term, or when at least ``soft_distinct``
    different soft terms are found and their weights, each counted once, reach ``soft_threshold``;
    else allow. Escapes like ``%20`` are decoded for the vocabulary, once, not for the rules.

    Null urls and urls without ``://`` have an empty host and path, fit no rule,
    and are judged by the vocabulary alone (null: allow). Repeated rows stay
    repeated; columns of ``pages`` named like a new one are replaced. Rules and
    vocabulary are parameters and go to the tasks as they are; rows are judged
    one by one, with no shuffle, so hot hosts cost nothing.
    """
    by_host, strict, soft = _by_host(rules), list(strict), dict(soft)

    @F.pandas_udf("rule string, verdict string, strict_terms string, soft_terms string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        machine = _automaton(strict, soft) if strict or soft else None
        for urls, hosts, paths in batches:
            out = []
            for url, host, path in zip(urls, hosts, paths):
                hard, mild = _hits(_plain(url), machine) if url and machine else ((), {})
                fit = _rule_for(host, path, by_host)
                if fit:
                    rule, verdict = fit
                else:
                    rule = None
                    soft_hit = len(mild) >= soft_distinct and sum(mild.values()) >= soft_threshold
                    verdict = "block" if hard or (mild and soft_hit) else "allow"
                out.append((rule, verdict, ",".join(sorted(hard)), ",".join(sorted(mild))))
            yield pd.DataFrame(out, columns=["rule", "verdict", "strict_terms", "soft_terms"])

    new = ["host", "path", "rule", "verdict", "strict_terms", "soft_terms"]
    kept = [c for c in pages.columns if c not in new]
    url = F.col(url_col)
    parts = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parts.withColumn("__j", judge(url, F.col("host"), F.col("path")))
    return judged.select(*kept, "host", "path", *[F.col(f"__j.{c}").alias(c) for c in new[2:]])


ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}
ESCAPE = re.compile("%([0-9a-f]{2})")


def filter_sql(source: str = "pages") -> str:
    """``filter_urls`` with its defaults, for (page_id, url), as DuckDB SQL."""
    after = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    fits = " ".join(
        f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) "
        f"and starts_with(path, '/{r.partition('/')[2]}') then '{r}'"
        for r, _ in sorted(RULES, key=lambda x: -len(x[0]))
    )
    verdicts = " ".join(f"when '{r}' then '{v}'" for r, v in RULES)
    hit = "regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)')"
    strict = [f"case when {hit.format(t)} then '{t}' end" for t in sorted(STRICT_TERMS)]
    soft = [f"case when {hit.format(t)} then '{t}' end" for t in sorted(SOFT_TERMS)]
    weight = " + ".join(f"case when {hit.format(t)} then {w} else 0 end" for t, w in SOFT_TERMS.items())
    # what follows each percent sign: an escape and the rest, or no escape
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    sign = f"translate(chr(cast('0x' || p[1:2] as int)), '{UPPER}', '{LOWER}')"
    decoded = f"case when regexp_full_match({sign}, '[a-z0-9]') then {sign} else ' ' end || p[3:]"
    pieces = (
        f"list_transform(string_split({low}, '%')[2:], "
        f"lambda p: case when regexp_matches(p, '^[0-9a-f][0-9a-f]') then {decoded} else '%' || p end)"
    )
    return f"""
    with parts as (
        select page_id, url, string_split({low}, '%')[1] || array_to_string({pieces}, '') as low, {after} as rest
        from {source}
    ), split as (
        select page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
    ), found as (
        select page_id, host, path, case {fits} end as rule, concat_ws(',', {", ".join(strict)}) as strict_terms,
               concat_ws(',', {", ".join(soft)}) as soft_terms, {weight} as weight from split
    )
    select page_id, host, path, rule, case when rule is not null then case rule {verdicts} end
           when strict_terms <> '' then 'block'
           when soft_terms <> '' and length(soft_terms) - length(replace(soft_terms, ',', '')) + 1 >= {SOFT_DISTINCT}
                and weight >= {SOFT_THRESHOLD} then 'block' else 'allow' end as verdict,
           strict_terms, soft_terms
    from found
    """
