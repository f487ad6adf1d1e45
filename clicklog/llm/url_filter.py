"""URL filter: rules, else logistic regression on hashed character n-grams of host and path.

The regression is trained from a small labelled URL table; a longest fitting rule overrides it.

Nulls: a null url, or one without ``://``, has an empty host and path and gets the model's verdict on them.
Empty and very long urls are judged whole. Repeated rows get equal verdicts. An empty table gives an empty result.
Input columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklog.llm import words
from clicklog.llm.store import spare

BUCKETS = 1 << 15
LENGTHS = (3, 4, 5)

# fixed values: the small labelled URL table, as (invented) names of unwanted and of ordinary sites
UNWANTED = """casino-royal casino-best-odds online-casino24 win-big-jackpot poker-bonus bet-win-odds slots-palace free-spins-now roulette-cash
gambling-slots vegas-casino-club lucky-jackpot777 betting-tips-vip bets-of-the-day sports-bets-online bingo-bonus-win adult-cams adult-videos-hot
xxx-adult-pics porn-tube-hd sex-cams-live hot-adult-dating nude-pics-xxx webcam-girls-xxx escort-sex-club free-porn-movies pills-discount-shop
buy-viagra-cheap cialis-pills pharma-pills-online weight-loss-pills cheap-meds-rx no-prescription-pills spam-blaster link-farm-seo seo-spam-links
buy-backlinks-cheap spam-offers email-spam-list mass-mailer-spam click-bait-offers ads-delivery-server track-ads-pixel popup-ads-server adserver-click
banner-ads-count adclick-tracking pixel-track-stats malware-download warez-crack keygen-serials cracked-apps-free phish-login-bank
verify-account-login secure-bank-verify free-robux-hack quick-payday-loan instant-cash-loans get-rich-quick crypto-double-win
bitcoin-giveaway-win forex-profit-signals earn-cash-fast replica-watches-cheap fake-designer-bags torrent-warez-free win-free-iphone
claim-your-prize lottery-winner-claim miracle-weight-loss miracle-cure-pills fake-diploma-buy betwin88 casinoking pornhouse sexdate pillsmart
viagrastore spambot adsnet xxxtube clickads warezhub trackpixel cheapmeds megaslots bet-mega-bonus superbet99 betting365 xxx-films-rated xrated-clips
rich-fast-money fast-cash-rich phishing-kit phishing-mail-login paypal-phish bank-phishing account-verify-now farm-of-spam-links track-my-ads
discount-pills-online win-at-casino bets-without-limit""".split()
ORDINARY = """garden river weather city-news university museum health recipes travel school history sports science parliament coding bikes
northern anthem motion earth other the-times free-library winter-school online-courses city-library freedom freelance-writers open-university
public-health national-park music-academy daily-herald evening-post mountain-club sailing-club book-club film-archive photo-archive
kitchen-garden farmers-market flower-shop coffee-house restaurant-guide hotel-guide train-times bus-timetable harbour fire-brigade tax-office
town-council embassy court-records law-review medical-journal hospital pharmacy-board animal-shelter bird-watching fishing hiking running
cycling football-league cricket winners-circle window-repair wind-energy solar-power engineering physics chemistry astronomy economics
language-school dictionary translation poetry theatre orchestra jazz childrens-books family-advice pension insurance-guide bank-of-town
credit-union property plumbing open-source developer-docs data-portal maps web-archive forum community charity volunteer events-calendar
tickets-office radio magazine racetrack track-cycling cheap-flights-guide betty-crafts essex-county sussex-news adult-education clicking-beetles
spinning-wool slotcar-racing pixel-art farm-life adventure adverbs advisory-board middle-school twins loans-of-art pillar-and-stone bookmakers-guild maths-online.edu online-lectures.edu online-campus
freeholder-rights law-for-tenants free-legal-advice freehold-houses housing-law richmond-park paper-trail mailing-guild banking-history
accounting-course phishing-awareness alphabet-books better-health betony-nursery casinoto-village farm-shop spa-town megalith-walks that-old-house thatched-roofs
hatters-guild thoughts-and-letters there-and-back whatever-weather""".split()
_STARTS = ["http://www.", "https://", "http://", "https://m.", "https://blog.", "https://www."]
_ENDS = [".example", ".example.com", ".example.org", "", ".example.net"]
_PATHS = ["/en/12", "/fr/8?page=2", "/de/77/", "/es/340.html", "/2019/05/a-long-title-of-a-post", "/", "", "/about", "/en/news/3", "/item?id=5518", "/p/91#top"]
#: The labelled urls (1 block, 0 allow). Starts, ends and paths are dealt in turn, so that they tell nothing; what has no host is ordinary.
LABELLED = [
    (f"{_STARTS[(i + 2 * k) % len(_STARTS)]}{name}{_ENDS[(i + 3 * k) % len(_ENDS)]}{_PATHS[(i + 5 * k) % len(_PATHS)]}", label)
    for label, names in ((1, UNWANTED), (0, ORDINARY)) for i, name in enumerate(names) for k in range(3)
] + [("", 0)] * 8

#: (verdict, rule): a rule fits its host and all subdomains when the path starts with the rule's path; longest wins.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda x: len(x[1])):
        site, slash, start = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def ngrams(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: the buckets of all byte n-grams that stay in a row, and each row's bounds in them."""
    for _, data, offsets in words.chunks(text):
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        code, found, rows = words.LOWER[data].astype(np.uint64), [], []
        rolled = code
        for n in range(2, max(LENGTHS) + 1):
            if len(code) < n:
                break
            rolled = rolled[:-1] * np.uint64(257) + code[n - 1 :]
            inside = row[: len(rolled)] == row[n - 1 :]
            if n in LENGTHS:
                found.append((words.mix(rolled[inside], n) % np.uint64(BUCKETS)).astype(np.int64))
                rows.append(row[: len(rolled)][inside])
        grams, rows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, rows))
        order = np.argsort(rows, kind="stable")
        yield grams[order], np.searchsorted(rows[order], np.arange(len(offsets)))


def parts(url: str) -> str:
    """Host and path of a labelled url, marked at their ends, as the model sees them."""
    _, found, rest = url.partition("://")
    rest = rest.split("?")[0].split("#")[0] if found else ""
    host, slash, path = rest.partition("/")
    return f"^{host.lower()}$ {slash}{path}"


def train(labelled: list[tuple[str, int]], epochs: int = 300, rate: float = 2.0, decay: float = 3e-4) -> np.ndarray:
    """Weights of the regression (the last one the intercept), by gradient descent with momentum on log-loss; both labels weigh
    the same in all."""
    y = np.array([label for _, label in labelled], dtype=float)
    x = np.zeros((len(labelled), BUCKETS + 1))
    done = 0
    for grams, bounds in ngrams(pa.array([parts(url) for url, _ in labelled])):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            np.add.at(x[done], grams[a:b], 1 / max(1.0, (b - a) ** 0.5))
            done += 1
    x[:, -1] = 1
    used = np.flatnonzero(x.any(0))  # other columns keep weight 0
    x, w, speed = x[:, used], np.zeros(len(used)), np.zeros(len(used))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(epochs):
        speed = 0.9 * speed - (x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y) * weight) + decay * w)
        w += rate * speed
    out = np.zeros(BUCKETS + 1)
    out[used] = w
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """``pages`` (page_id, url, ...) with ``host, path, rule, verdict`` and the model's ``block_score``."""
    weights = train(LABELLED if labelled is None else labelled)
    pages = pages.drop("host", "path", "rule", "verdict", "block_score").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    kept, seen = pages.columns, spare([*pages.columns, "block_score"], "seen")
    pages = pages.withColumn(seen, F.concat(F.lit("^"), "host", F.lit("$ "), "path"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for grams, bounds in ngrams(batch.column(seen)):
                out.append(1 / (1 + np.exp(-(words.sums(weights[grams], bounds) / np.sqrt(np.maximum(np.diff(bounds), 1)) + weights[-1]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(out))], [*kept, "block_score"])

    scored = pages.mapInArrow(score, pages.drop(seen).schema.add("block_score", "double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    by_model = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_model))
