"""URL filters: rules, and for the rest a tree of path templates per host.

A rule names a host (it holds for subdomains, too) and the start of a path; the
longest that fits decides. Pages that a rule decides are labelled by it, and the
tree carries these labels over to pages no rule speaks of:

1. Paths are counted per host with their numbers generalised.
2. Going down the tree, a node whose children are nearly all different is taken
   to vary there: its rare children become one wildcard.
3. Sibling branches that do not differ significantly from all branches of their
   node (in the share of blocked labels, and of paths that go on) are merged.
4. The blocked share of a branch is smoothed by that of its node, down from the
   share among all labels. Templates whose smoothed share is high are rejected,
   if their host has a label at all: the share of other hosts is no evidence.

The tree goes down until no path has a further segment. A path that is alone in its
node is taken to its end at once, as what is left of it cannot differ from its node.
All steps are grouping and joins of counts; no step lists the children of a node in
one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import cut

# A node varies if it has so many children, and so many of its paths each.
LEAST_CHILDREN, LEAST_VARIETY = 8, 0.5
# A child of so many paths, and of such a share of its node's, stays itself.
OFTEN, OFTEN_SHARE = 10, 0.05
# Error of the test that keeps branches apart (1.358 = sqrt(ln(2 / 0.05) / 2)).
BOUND = 1.3581
# Labels that the node's blocked share counts as, and the share that is rejected.
SMOOTHING = 4.0
REJECT = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path of a URL; both are empty if it is
    null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_length(rules) -> list[Rule]:
    """The rules, longest first; of equally long ones that with the longer host."""
    return sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))


def generalised(path: Column) -> Column:
    """A path in which a segment that is a number, perhaps with an ending, has
    become a wildcard."""
    return F.regexp_replace(path, r"(^|/)[0-9]+(\.[A-Za-z0-9]+)?(?=/|$)", "$1*$2")


def _sums(*names: str) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


COUNTS = ("n", "labelled", "blocked", "more", "going")


def _descend(rows: DataFrame, level: int) -> DataFrame:
    """Takes the rows that have a segment on this level into a branch of their
    node (``host``, ``node``), and gives them the branch's ``share``."""
    here = F.size("segments") > level
    segment = F.element_at("segments", F.least(F.lit(level + 1), F.size("segments")))
    rows = rows.withColumn("segment", F.when(here, segment)).withColumn(
        "more", F.when(F.size("segments") > level + 1, F.col("n")).otherwise(F.lit(0))
    ).withColumn("going", F.when(F.size("segments") > level + 1, 1).otherwise(0))
    active = rows.where(here)
    children = active.groupBy("host", "node", "segment").agg(*_sums(*COUNTS), F.first("share").alias("share"))
    whole = {name: f"all_{name}" for name in COUNTS}
    nodes = (
        children.groupBy("host", "node")
        .agg(*_sums(*COUNTS), F.count("*").alias("all_children"))
        .withColumnsRenamed(whole)
    )
    varies = (F.col("all_children") >= LEAST_CHILDREN) & (
        F.col("all_children") >= LEAST_VARIETY * F.col("all_n")
    )
    often = (F.col("n") >= OFTEN) & (F.col("n") >= OFTEN_SHARE * F.col("all_n"))
    tokens = children.join(nodes, ["host", "node"]).withColumn(
        "token", F.when(varies & ~often, F.lit("*")).otherwise(F.col("segment"))
    )
    branches = tokens.groupBy("host", "node", "token").agg(
        *_sums(*COUNTS), *[F.first(name).alias(name) for name in [*whole.values(), "share"]]
    )

    def alike(part: str, of: str) -> Column:
        """Whether a branch's share is that of its node, up to chance."""
        own = F.col(part).cast("double") / F.col(of)
        node = F.col(f"all_{part}").cast("double") / F.col(f"all_{of}")
        chance = BOUND * (1 / F.sqrt(F.col(of)) + 1 / F.sqrt(F.col(f"all_{of}")))
        return (F.col(of) == 0) | (F.abs(own - node) < chance)

    merged = alike("blocked", "labelled") & alike("more", "n")
    branches = branches.withColumn("branch", F.when(merged, F.lit("+")).otherwise(F.concat(F.lit("="), "token")))
    shares = branches.groupBy("host", "node", "branch").agg(
        *_sums("labelled", "blocked", "going"), F.first("share").alias("share")
    )
    shares = shares.select(
        "host",
        "node",
        "branch",
        (F.col("going") == 1).alias("alone"),
        ((F.col("blocked") + SMOOTHING * F.col("share")) / (F.col("labelled") + SMOOTHING)).alias("new_share"),
    )
    found = (
        tokens.select("host", "node", "segment", "token")
        .join(branches.select("host", "node", "token", "branch"), ["host", "node", "token"])
        .join(shares, ["host", "node", "branch"])
        .select("host", "node", "segment", "branch", "alone", "new_share")
    )
    left = F.when(F.col("alone"), F.greatest(F.size("segments") - (level + 1), F.lit(0))).otherwise(F.lit(0))
    rows = (
        rows.join(found, ["host", "node", "segment"], "left")
        .withColumn("left", left)
        .withColumn("share", F.coalesce("new_share", "share"))
    )
    # A path on its own is like its node on every level left, which draws the share
    # to that of its labels, each time by the same factor.
    own = F.col("blocked") / F.col("labelled")
    drawn = own + (F.col("share") - own) * F.pow(SMOOTHING / (F.col("labelled") + SMOOTHING), F.col("left"))
    return rows.select(
        "host",
        "shape",
        F.when(F.col("left") > 0, F.slice("segments", 1, level + 1)).otherwise(F.col("segments")).alias("segments"),
        "n",
        "labelled",
        "blocked",
        F.when(F.col("branch").isNull(), F.col("node"))
        .otherwise(F.concat(F.col("node"), F.lit("/"), F.col("branch"), F.repeat(F.lit("/+"), F.col("left"))))
        .alias("node"),
        F.when((F.col("left") > 0) & (F.col("labelled") > 0), drawn).otherwise(F.col("share")).alias("share"),
    )


def template_shares(labelled: DataFrame) -> DataFrame:
    """``template``, smoothed blocked ``share`` and ``known`` (whether its host has
    labels) of each ``host`` and ``shape`` (generalised path), from pages with
    those and ``label`` (1 blocked, 0 allowed, null unknown)."""
    counted = labelled.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count("label").alias("labelled"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked"),
    )
    counted = cut(counted)
    of_all = counted.agg(*_sums("labelled", "blocked")).first()
    start = ((of_all["blocked"] or 0) + 1) / ((of_all["labelled"] or 0) + 2)
    rows = counted.select(
        "*",
        # The part before the first slash is empty, or no part of a tree.
        F.expr("slice(split(shape, '/'), 2, 1000000)").alias("segments"),
        F.lit("").alias("node"),
        F.lit(start).alias("share"),
    )
    level = 0
    while rows.where(F.size("segments") > level).take(1):
        rows = cut(_descend(rows, level))
        level += 1
    hosts = counted.where("labelled > 0").select("host", F.lit(True).alias("known")).distinct()
    return rows.join(hosts, "host", "left").select(
        "host",
        "shape",
        F.col("node").alias("template"),
        "share",
        F.coalesce("known", F.lit(False)).alias("known"),
    )


def judged(
    pages: DataFrame,
    rules=RULES,
    reject: float = REJECT,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """One row per page: its id, ``host``, ``path``, ``rule`` (the longest that
    fits, else null), ``verdict`` (allow or block), ``template`` and ``share``.

    A null URL and one without ``://`` have an empty host and path, to which no
    rule fits; they form one template. Ids may be null or repeat, every row gets
    a verdict. On a host without any label all is allowed; the share then is that
    of all labels. Other columns play no part. An empty table gives an empty table.
    """
    host, path = host_and_path(F.col(f"`{url_column}`").cast("string"))
    rows = pages.select(F.col(f"`{id_column}`").alias("_uf_id"), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(by_length(rules)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    rows = rows.select(
        "*", rule.alias("rule"), verdict.alias("ruled"), generalised(F.col("path")).alias("shape")
    )
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    shares = template_shares(rows.withColumn("label", label))
    bad = F.col("known") & (F.col("share") >= reject)
    return rows.join(shares, ["host", "shape"]).select(
        F.col("_uf_id").alias(id_column),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
        F.round("share", 9).alias("share"),
    )
