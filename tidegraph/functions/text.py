"""Text, account and JSON column functions."""

from __future__ import annotations

import html
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of verdicts and the veracity of each verdict.
TRUE_FORMS = ("vero", "vera", "veri", "vere")
FALSE_FORMS = ("falso", "falsa", "falsi", "false")
VERACITY = {"falso": 0, "perlopiù falso": 1, "perlopiu' falso": 1, "misto": 2, "incerto": 2, "perlopiù vero": 3, "perlopiu' vero": 3, "vero": 4, "non verificabile": 5}
NO_DATE = "data sconosciuta"
NO_SOURCE = "(nessuna fonte trovata)"


#: White space between words, as Python's ``str.split`` has it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def clean_html(content: Column) -> Column:
    """Tags to blanks, character references decoded, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(decode_references(F.regexp_replace(content, r"<[^>]+>", " ")), SPACE, " "))


def _lookup(table: dict[str, str]) -> Column:
    """A constant map, folded into the plan from one string."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


def decode_references(text: Column) -> Column:
    """Character references as HTML 5 reads them, in one pass without Python: ``html.unescape`` as an expression.

    The text is split at its ampersands; what follows one is looked up by name (up to a semicolon, else the longest
    old name that it begins with) or taken as a number.  Other ampersands stay.
    """
    # one map for each first letter ('A' is 65, 'z' 122): a lookup looks through its map
    closed = F.array(*[_lookup({k: v for k, v in entities.html5.items() if k.endswith(";") and ord(k[0]) == c}) for c in range(65, 123)])
    named = lambda name: F.get(closed, F.ascii(name) - 65)[name]
    old = {k: v for k, v in entities.html5.items() if not k.endswith(";")}
    prefix = f"^({'|'.join(sorted(old, key=len, reverse=True))})"
    low = F.split(F.lit("\x01".join(html.unescape(f"&#{n};") for n in range(256))), "\x01")
    bad = F.lit("\ufffd")

    def number(digits: Column, base: int) -> Column:
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
        n = F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("bigint")).otherwise(F.lit(2**31))
        letter = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return F.when(n < 256, F.get(low, n.cast("int"))).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), bad).when(none, "").otherwise(letter)

    def decoded(part: Column) -> Column:
        decimal, hexa = F.regexp_extract(part, "^#([0-9]+);?", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+);?", 1)
        name, short = F.regexp_extract(part, "^[^\\t\\n\\f <&#;]{1,32};", 0), F.regexp_extract(part, prefix, 1)
        after = lambda taken: F.substr(part, F.length(taken) + 1)
        rest = F.regexp_replace(part, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
        return (
            F.when(decimal != "", F.concat(number(decimal, 10), rest)).when(hexa != "", F.concat(number(hexa, 16), rest))
            .when((name != "") & named(name).isNotNull(), F.concat(named(name), after(name)))
            .when(short != "", F.concat(_lookup(old)[short], after(short))).otherwise(F.concat(F.lit("&"), part))
        )

    def joined(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))

    return F.get(F.transform(F.array(F.split(text, "&")), joined), F.lit(0))  # a list of one binds the parts, so that ``text`` is computed once


def clean_html_basic(content: Column) -> Column:
    """T1 without Python: decodes only the five references that XML defines."""
    out = F.regexp_replace(content, r"<[^>]+>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def canonical_acct(acct: Column, domain: Column, fold_case: bool = False) -> Column:
    """A bare account name gets its server's domain."""
    out = F.when(acct.contains("@"), acct).otherwise(F.concat_ws("@", acct, domain))
    return F.lower(out) if fold_case else out


def account_label(acct: Column) -> Column:
    """T3: '@name', as it is where it has the sign already."""
    return F.when(acct.startswith("@"), acct).otherwise(F.concat(F.lit("@"), acct))


def account_domain(acct: Column) -> Column:
    """The domain of a qualified name, else 'fediverse'."""
    return F.when(acct.contains("@"), F.element_at(F.split(acct, "@"), -1)).otherwise(F.lit("fediverse"))


def normalize_verdict(verdict: Column) -> Column:
    """T4: trimmed, lower case, forms of true and false unified."""
    v = F.lower(F.trim(verdict))
    return F.when(v.isin(*TRUE_FORMS), "vero").when(v.isin(*FALSE_FORMS), "falso").otherwise(v)


def veracity_of(verdict: Column) -> Column:
    """T5: 0 to 4 on the scale from false to true, 5 for everything that isn't on it."""
    out = F.lit(5)
    for name, value in VERACITY.items():
        out = F.when(verdict == name, value).otherwise(out)
    return out


def search_query(text: Column, words: int = 30) -> Column:
    """The first words of a claim."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " ")


def date_or_default(created_at: Column) -> Column:
    """The day of a post, or the words for an unknown one."""
    return F.coalesce(F.date_format(created_at, "yyyy-MM-dd"), F.lit(NO_DATE))


def evidence_urls(joined: Column) -> Column:
    """The addresses of a ';'-joined list."""
    return F.filter(F.transform(F.split(joined, ";"), lambda u: F.trim(u)), lambda u: u.startswith("http"))


def json_count(raw: Column, field: str) -> Column:
    """A whole number in a JSON document, 0 when absent or malformed."""
    return F.coalesce(F.get_json_object(raw, f"$.{field}").try_cast("bigint"), F.lit(0).cast("bigint"))


def log_weight(weight: Column, largest: Column) -> Column:
    """Log-scaled weight in [0, 1]."""
    return F.when(largest > 0, F.log1p(weight) / F.log1p(largest)).otherwise(F.lit(0.0))


def efficiency(direct: Column, followers: Column) -> Column:
    """Direct reach per follower, 0 without followers."""
    return F.when(followers > 0, direct / followers).otherwise(F.lit(0.0))


def node_group(bot: Column, degree: Column, hub: int = 4) -> Column:
    """Bots, hubs, and the rest."""
    return F.when(bot, "bot").when(degree >= hub, "instance").otherwise("human")
