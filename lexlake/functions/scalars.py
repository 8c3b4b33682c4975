"""Column functions. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexlake.schemas import VOTES


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_blank(c), r"(?U)\s+", " "))


def strip_markup(c: Column) -> Column:
    return collapse(F.regexp_replace(text_or_blank(c), "<[^>]+>", " "))


def first_match(c: Column, pattern: str, then, otherwise: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(pattern)), then).otherwise(otherwise)


# --- docket numbers ---------------------------------------------------------------------------------------------------

# Shapes of docket numbers.
SYNTHETIC_CASE = r"(?i)^cl-\d+$"
STEM_CASE = r"^([aA])(\d{2})(\d{4})$"
LEADING_NO = r"^N[Oo][Ss]?\.?\s+(.*)$"
UNPADDED_CASE = r"^([A-Z])(\d{2})-(\d{1,3})$"
DOCKET_SHAPES = (r"^ADM(\d{2})-?(\d{4})$", r"^([A-Z])(\d{2})-?(\d{4})$", r"^C(\d{1,2})-?(\d{2})-?(\d{4})$")
DIVISION = r"(?i)^([12])[\s-]*CA"


def part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def canonical_case_number(c: Column) -> Column:
    """One pass: synthetic numbers stay, stems get their dash, a leading "No." goes, short sequences are padded. The
    branches exclude each other, so a stem behind "No." keeps its spelling in this pass."""
    s = F.trim(text_or_blank(c))
    bare = F.when(F.regexp_like(s, F.lit(LEADING_NO)), F.trim(part(s, LEADING_NO, 1))).otherwise(s)
    padded = F.concat(part(bare, UNPADDED_CASE, 1), part(bare, UNPADDED_CASE, 2), F.lit("-"), F.lpad(part(bare, UNPADDED_CASE, 3), 4, "0"))
    return (
        F.when((s == "") | F.regexp_like(s, F.lit(SYNTHETIC_CASE)), s)
        .when(F.regexp_like(s, F.lit(STEM_CASE)), F.concat(F.upper(part(s, STEM_CASE, 1)), part(s, STEM_CASE, 2), F.lit("-"), part(s, STEM_CASE, 3)))
        .when(F.regexp_like(bare, F.lit(UNPADDED_CASE)), padded)
        .otherwise(bare)
    )


def is_normalizable(c: Column) -> Column:
    s = F.trim(text_or_blank(c))
    return (s != "") & (canonical_case_number(c) != s)


def normalize_docket(c: Column) -> Column:
    """Dashed upper-case form of the known shapes; anything else only in upper case."""
    s = F.upper(F.trim(text_or_blank(c)))
    adm, letter, old = DOCKET_SHAPES
    return (
        F.when(F.regexp_like(s, F.lit(adm)), F.concat(F.lit("ADM"), part(s, adm, 1), F.lit("-"), part(s, adm, 2)))
        .when(F.regexp_like(s, F.lit(letter)), F.concat(part(s, letter, 1), part(s, letter, 2), F.lit("-"), part(s, letter, 3)))
        .when(F.regexp_like(s, F.lit(old)), F.concat(F.lit("C"), part(s, old, 1), F.lit("-"), part(s, old, 2), F.lit("-"), part(s, old, 3)))
        .otherwise(s)
    )


def appeals_division(c: Column) -> Column:
    """The division in an appellate docket, null without one."""
    s = F.regexp_replace(F.trim(text_or_blank(c)), r"^N[Oo][Ss]?\.?\s*", "")
    return F.nullif(part(F.translate(s, "–—", "--"), DIVISION, 1), F.lit(""))


def is_docket_like(c: Column) -> Column:
    return (F.length(c) <= 24) & ~F.contains(c, F.lit(" ")) & (F.contains(c, F.lit("-")) | F.regexp_like(c, F.lit(r"^[A-Za-z]\d")))


# --- outcomes, votes, courts -----------------------------------------------------------------------------------------------

# How a disposition reads (where it must stand, words) and its bucket, first match first.
DISPOSITIONS = (
    ("in", ("in part",), "mixed"), ("in", ("vacated",), "vacated"), ("in", ("reversed",), "reversed"), ("start", ("remanded",), "remanded"), ("start", ("affirmed",), "affirmed"),
    ("start", ("modified",), "modified"), ("start", ("dismissed", "stayed", "reinstated"), "dismissed"), ("start", ("granted",), "granted"), ("start", ("denied",), "denied"),
)
COURT_LABELS = {("MN", "SUPREME"): "Minn.", ("MN", "APPEALS"): "Minn. Ct. App.", ("NH", "SUPREME"): "N.H.", ("AZ", "SUPREME"): "Ariz.", ("AZ", "APPEALS"): "Ariz. Ct. App.", ("LA", "SUPREME"): "La.", ("LA", "APPEALS"): "La. Ct. App."}
ORDINALS = {"1": "1st", "2": "2nd", "3": "3rd", "4": "4th", "5": "5th"}


def disposition_bucket(c: Column) -> Column:
    d = F.trim(F.lower(text_or_blank(c)))
    out = F.when(d == "", "")
    for where, words, bucket in DISPOSITIONS:
        test = [F.contains(d, F.lit(w)) if where == "in" else F.startswith(d, F.lit(w)) for w in words]
        hit = test[0]
        for t in test[1:]:
            hit = hit | t
        out = out.when(hit, bucket)
    return out.otherwise("other")


def vote_bucket(c: Column) -> Column:
    out = None
    for vote, (_, bucket) in VOTES.items():
        out = F.when(c == vote, bucket) if out is None else out.when(c == vote, bucket)
    return out.otherwise("recused")


def vote_rank(c: Column) -> Column:
    out = None
    for vote, (rank, _) in VOTES.items():
        out = F.when(c == vote, rank) if out is None else out.when(c == vote, rank)
    return out.otherwise(-1)


def court_label(state: Column, level: Column, division: Column, name: Column) -> Column:
    base = None
    for (st, lv), label in COURT_LABELS.items():
        test = (state == st) & (level == lv)
        base = F.when(test, label) if base is None else base.when(test, label)
    base = base.otherwise(name)
    ordinal = F.coalesce(F.get(F.array(*[F.lit(v) for v in ORDINALS.values()]), F.try_to_number(division, F.lit("9")).cast("int") - 1), division)
    return F.when(text_or_blank(division) == "", base).when(state == "LA", F.concat(base, F.lit(" "), ordinal, F.lit(" Cir."))).otherwise(F.concat(base, F.lit(" Div. "), division))


# --- names ----------------------------------------------------------------------------------------------------------------

GENERATIONS = ("jr", "sr", "ii", "iii", "iv", "2", "3", "4", "2nd", "3rd", "4th")  # fixed values


def surname(full_name: Column) -> Column:
    """The last word of a name that is not a generation."""
    words = F.filter(F.split(F.trim(text_or_blank(full_name)), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,]+|[.,]+$", "")))
    last = F.array_max(F.filter(F.transform(bare, lambda w, i: F.when(~w.isin(*GENERATIONS), i)), lambda i: i.isNotNull()))
    return F.coalesce(F.get(words, last), F.lit(""))


#: What follows a name in a byline.
ROLE_SUFFIX = r"(?i),?\s*(?:(?:chief|presiding|associate|acting|vice)\s+)*(?:judge|justice|c\.?\s?j\.?|p\.?\s?j\.?|jj?\.)\s*$"


def byline_surname(name: Column) -> Column:
    """The last word of a name in a byline, without the role that follows it and what stands after a comma; generations are not told apart."""
    bare = F.element_at(F.split(F.trim(F.regexp_replace(text_or_blank(name), ROLE_SUFFIX, "")), ","), 1)
    return F.regexp_replace(F.regexp_extract(F.trim(bare), r"(\S+)$", 1), r"^[.,'\-]+|[.,'\-]+$", "")


def level_slug(level: Column) -> Column:
    return F.lower(text_or_blank(level))


def disposition_class(bucket: Column, disposition: Column) -> Column:
    """The stored bucket, or else that of the disposition."""
    return F.coalesce(blank_to_null(bucket), disposition_bucket(disposition))


def bar_width(part_: Column, whole: Column, most: int = 100) -> Column:
    """A share as a whole number of ``most``, halves up; 0 where there is no whole."""
    return F.coalesce(F.round(part_ / F.nullif(whole, F.lit(0)) * most), F.lit(0)).cast("int")


def inside_parenthesis(text: Column, at: Column, window: int = 150) -> Column:
    """Whether place ``at`` (from 0) stands in a parenthesis that opened within ``window`` characters and has not closed."""
    before = F.substring(text, F.greatest(at - window, F.lit(0)) + 1, F.least(at, F.lit(window)))
    last = lambda c: F.length(before) - F.instr(F.reverse(before), c)
    has = F.contains(before, F.lit("("))
    return has & (~F.contains(before, F.lit(")")) | (last("(") > last(")")))


def name_key(full_name: Column) -> Column:
    return F.translate(F.lower(collapse(full_name)), ".,", "")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_or_blank(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Words that do not tell captions apart.
CAPTION_NOISE = tuple("of the in re matter a an and et al state arizona minnesota new hampshire".split())


def caption_tokens(title: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text_or_blank(title)), r"(?U)[^\w\s]", " "), r"\bvs?\b", " ")
    return F.filter(F.array_distinct(F.split(plain, r"\s+")), lambda w: (w != "") & ~w.isin(*CAPTION_NOISE))


def captions_compatible(a: Column, b: Column) -> Column:
    """Half of the shorter caption's tokens are shared; a missing caption agrees with anything."""
    x, y = caption_tokens(a), caption_tokens(b)
    least = F.least(F.size(x), F.size(y))
    return (least == 0) | (F.size(F.array_intersect(x, y)) / F.nullif(least, F.lit(0)) >= 0.5)


# --- citations ----------------------------------------------------------------------------------------------------------------

MONTHS = ("Jan.", "Feb.", "Mar.", "Apr.", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec.")  # fixed values


def bluebook_date(d: Column) -> Column:
    return F.coalesce(F.concat(F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1), F.lit(" "), F.day(d), F.lit(", "), F.year(d)), F.lit(""))


def bluebook(title: Column, cite: Column, docket: Column, released: Column, court: str = "N.H.") -> Column:
    name, own, date = collapse(title), collapse(cite), bluebook_date(released)
    with_cite = F.concat(name, F.lit(", "), own, F.when(date != "", F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(""))
    without = F.concat(name, F.lit(", No. "), collapse(docket), F.lit(" ("), F.trim(F.concat(F.lit(court + " "), date)), F.lit(")"))
    return F.concat(collapse(F.when(own != "", with_cite).otherwise(without)), F.lit("."))


def plain_cite(title: Column, cite: Column, docket: Column) -> Column:
    own = collapse(cite)
    return collapse(F.when(own != "", F.concat(collapse(title), F.lit(", "), own)).otherwise(F.concat(collapse(title), F.lit(", No. "), collapse(docket))))


# --- dates and numbers ---------------------------------------------------------------------------------------------------------

def parse_date(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_date(c, f) for f in formats or ("yyyy-MM-dd",)])


def years_cutoff(years: str | None, ref_date: Column) -> Column | None:
    """None for "all"; otherwise ``ref_date`` less 365 days for each of 1 to 100 years, 10 where it can't be read."""
    if (years or "").strip().lower() == "all":
        return None
    n = int(years) if (years or "").strip().isdigit() else 10
    return F.date_sub(ref_date, 365 * (n if 1 <= n <= 100 else 10))


def decade(d: Column) -> Column:
    return (F.floor(F.year(d) / 10) * 10).cast("int")


def percent(part_: Column, whole: Column, digits: int = 1) -> Column:
    """Half to even; 0 where there is no whole."""
    return F.when(whole > 0, F.bround(100.0 * part_ / whole, digits)).otherwise(0.0)


def similarity_percent(distance: Column) -> Column:
    return F.coalesce(F.least(F.lit(100), F.greatest(F.lit(0), F.bround((1 - distance) * 100, 0).cast("int"))), F.lit(0))


def nice_max(v: Column) -> Column:
    """The top of a value axis. Steps below are fixed values."""
    up = lambda step: ((F.floor(v / step) + 1) * step).cast("long")
    return F.when(v <= 5, F.lit(5)).when(v <= 10, F.lit(10)).when(v <= 50, up(10)).when(v <= 200, up(25)).when(v <= 1000, up(100)).otherwise(up(500)).cast("long")


def tick_step(span: Column) -> Column:
    return F.when(span <= 5, 1).when(span <= 15, 2).when(span <= 40, 5).otherwise(10)


def bar(n: Column, largest: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("#"), F.floor(width * n / largest).cast("int"))


def tenure(seated: Column, appointed: Column, first: Column, last: Column) -> Column:
    y = lambda c: c.cast("string")
    return (
        F.when(seated & appointed.isNotNull(), F.concat(F.lit("Seated "), y(F.year(appointed))))
        .when(seated & first.isNotNull(), F.concat(F.lit("On the bench since "), y(first)))
        .when(seated, "Currently seated")
        .when(first.isNotNull() & (first == last), F.concat(F.lit("Active "), y(first)))
        .when(first.isNotNull() & last.isNotNull(), F.concat(F.lit("Active "), y(first), F.lit("–"), y(last)))
        .otherwise("Former judge")
    )


def token_estimate(text: Column, most: int = 16_000) -> Column:
    return F.least(F.floor(F.length(text) / 4).cast("int"), F.lit(most))


# --- addresses -----------------------------------------------------------------------------------------------------------------

def quote_path(c: Column) -> Column:
    """Percent-encoding in which "/" stays and a space is %20."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquote(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def client_network(forwarded: Column) -> Column:
    """The network block of the first address: /24 or /48, or "-"."""
    first = F.trim(F.get(F.split(text_or_blank(forwarded), ","), F.lit(0)))
    groups, octets = F.split(first, ":"), F.split(first, r"\.")
    v4 = F.regexp_like(first, F.lit(r"^\d+\.\d+\.\d+\.\d+$")) & F.forall(octets, lambda o: o.cast("decimal(38,0)") <= 255)
    return (
        F.when(F.contains(first, F.lit(":")), F.when(F.size(groups) >= 3, F.concat(F.concat_ws(":", F.slice(groups, 1, 3)), F.lit("::/48"))).otherwise("-"))
        .when(v4, F.concat(F.concat_ws(".", F.slice(octets, 1, 3)), F.lit(".0/24"))).otherwise("-")
    )


def state_of_host(host: Column) -> Column:
    """The two-letter subdomain of a host of three labels or more, without "www" and port; null otherwise."""
    labels = F.split(F.lower(F.regexp_replace(text_or_blank(host), r":\d+$", "")), r"\.")
    own = F.filter(labels, lambda x: x != "www")
    return F.when((F.size(own) >= 3) & (F.length(F.get(own, F.lit(0))) == 2), F.upper(F.get(own, F.lit(0))))


def archive_url(url: Column) -> dict[str, Column]:
    """case_number, date and category that the name of an archived file holds."""
    dated, bare = r"(?i)OP([A-Za-z]?\d+)-(\d{2})(\d{2})(\d{4}|\d{2})[^/]*\.pdf$", r"(?i)/([A-Za-z]\d{6,})\.pdf$"  # fixed values
    raw = F.coalesce(F.nullif(part(url, dated, 1), F.lit("")), F.nullif(part(url, bare, 1), F.lit("")))
    short = r"^([A-Za-z])(\d{2})(\d{3,4})$"
    case = F.when(F.regexp_like(raw, F.lit(short)), F.concat(F.upper(part(raw, short, 1)), part(raw, short, 2), F.lit("-"), F.lpad(part(raw, short, 3), 4, "0"))).otherwise(F.upper(raw))
    y = part(url, dated, 4)
    year = F.when(F.length(y) == 4, y).when(F.length(y) == 2, F.concat(F.lit("20"), y))
    date = F.try_to_date(F.concat_ws("-", year, part(url, dated, 2), part(url, dated, 3)), "yyyy-MM-dd")
    return {"case_number": case, "iso_date": F.when(year.isNotNull(), date), "category": F.nullif(F.lower(part(url, r"(?i)/archive/(ctappub|ctapun|COAspectorders|supct)/", 1)), F.lit(""))}


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight(escaped: Column, query: str) -> Column:
    quoted = query.replace("\\E", "\\E\\\\E\\Q")
    return F.regexp_replace(escaped, f"(?iu)\\Q{quoted}\\E", "<mark>$0</mark>")


def title_case(c: Column) -> Column:
    """Words in capitals get one capital; mixed case stays."""
    return F.array_join(F.transform(F.split(text_or_blank(c), " "), lambda w: F.when((w == F.upper(w)) & (F.length(w) > 1), F.concat(F.substring(w, 1, 1), F.lower(w.substr(F.lit(2), F.length(w))))).otherwise(w)), " ")
