"""Main text of web pages by wrappers: union-free regular expressions inferred from each host's pages."""

from __future__ import annotations

import difflib
import functools
import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import broadcast_if_small, col, free_name, hash_sample, map_arrow, materialise, only_columns

# Element names by their role in HTML.
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title")
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th option".split())
_ASIDE = frozenset("nav footer aside form head button select menu dialog fieldset label option search".split())
_MAIN = frozenset("article main".split())
#: Words of a class or id that mark a region beside the main text.
_BESIDE = re.compile(r"(?i)(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|masthead|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])")

#: Those of them that are also words of texts: inside a main region, or on it, they leave the verdict to what stands there.
_VAGUE = re.compile(r"(?i)(?:^|[\s_-])(?:banner|breadcrumbs?|masthead|menu|nav\w*|notices?|related|share|sharing|social|toolbar|widget)(?:$|[\s_-])")

#: Words of a class or id that mark a page's header, which is beside the main text unless it lies in it.
_TOP = re.compile(r"(?i)(?:^|[\s_-])(?:header|topbar|top-bar)(?:$|[\s_-])")

# A drawing may close itself; of elements that nothing closes, only scripts, styles and plain texts reach to the end of the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?<=/)>"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?</(?P=raw)\s*>"
    r"|<(?:script|style|title|textarea)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*\Z"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z",
    re.S | re.I,
)
_MARK = re.compile(r"""(?i)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """The text blocks of a page in order: the path of open containers, the text, characters in links."""
    stack: list[str] = []
    leaf, parts, linked, in_link = "", [], 0, 0

    def flush():
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        link, parts, linked = linked, [], 0
        return ((*stack, leaf) if leaf else tuple(stack), text, link) if text else None

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            parts.append(page[at : token.start()])
            linked += in_link and len("".join(page[at : token.start()].split()))
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name not in _BLOCKS and name not in ("button", "select", "label", "option"):
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = 0 if token["end"] else 1
            continue
        block = flush()
        if block:
            yield block
        if name in _LEAF:
            leaf = "" if token["end"] else name
            if name == "li" and not token["end"]:
                in_link = 0
            continue
        if token["end"]:
            tails = [i for i, x in enumerate(stack) if x.split(".")[0] == name]
            if tails:
                del stack[tails[-1] :]
            leaf = ""
        elif name not in _VOID:
            marks = sorted({w for _, v in _MARK.findall(token["attrs"]) for w in v.strip("\"'").lower().split()})
            stack.append(".".join([name, *(re.sub(r"\d+", "", m) for m in marks)]))
            leaf = ""
    parts.append(page[at:])
    block = flush()
    if block:
        yield block


@functools.lru_cache(maxsize=10_000)
def _marks(step: str) -> tuple[bool, bool, bool, bool]:
    """Whether a container's name, class or id speaks of a region beside the main text (vaguely, if by words of texts alone), of a header, of the main text."""
    name, *marks = step.split(".")
    spoken = [m for m in marks if _BESIDE.search(m)]
    vague = bool(spoken) and name not in _ASIDE and all(_VAGUE.search(m) for m in spoken)
    return name in _ASIDE or bool(spoken), vague, name == "header" or any(_TOP.search(m) for m in marks), name in _MAIN or "main" in marks


def _role(path: tuple[str, ...], whole: frozenset[tuple[str, ...]] = frozenset()) -> str:
    """What a container path says: ``beside``, ``main``, ``open``, or ``doubt`` in a main region; marks of the containers in ``whole`` do not count."""
    main = doubt = False
    for i, step in enumerate(path):
        beside, vague, top, inner = _marks(step)
        if path[: i + 1] not in whole:
            if vague and (main or inner):
                doubt = True
            elif beside or (top and not main):
                return "beside"
        main = main or inner
    return ("doubt" if doubt else "main") if main else "open"


def _blamed(path: tuple[str, ...], whole: frozenset[tuple[str, ...]]) -> tuple[str, ...] | None:
    """The outermost container that puts a path beside the main text by its class or id, not by what the element is."""
    for i in range(len(path)):
        if _role(path[: i + 1], whole) == "beside":
            return None if path[i].split(".")[0] in _ASIDE | {"header"} else path[: i + 1]
    return None


def _reads_on(text: str, link: int) -> bool:
    """Whether a text in doubt reads as one, not as a row of buttons."""
    return 2 * link <= len(text) and len(text) >= 40


@dataclass
class Node:
    """A part of an expression: a text slot, or a group of parts; each repeated or optional or both.

    ``n`` counts the pages that have it; ``common`` are the hashes of a slot's texts that all of them have, and it is ``fixed``
    while they have no other.
    """

    path: tuple[str, ...] = ()
    parts: list[Node] = field(default_factory=list)
    plus: bool = False
    optional: bool = False
    common: frozenset[str] = frozenset()
    fixed: bool = True
    n: int = 1
    chars: int = 0
    link: int = 0
    blocks: list[int] = field(default_factory=list)  #: of the page that is being read
    label: str = ""

    @property
    def key(self) -> tuple:
        """What two nodes must share to match: a slot's path, or the keys of a group's parts."""
        return ("group", *(x.key for x in self.parts)) if self.parts else self.path

    def slots(self) -> Iterator[Node]:
        if self.parts:
            for part in self.parts:
                yield from part.slots()
        else:
            yield self


def _joined(a: Node, b: Node, same_page: bool) -> Node:
    """Two nodes of one key as one: on one page a repetition, on two pages the same part of both.

    Where the texts of two pages differ, a constant becomes a variable slot."""
    common = a.common | b.common if same_page else a.common & b.common
    return Node(
        a.path, [_joined(x, y, same_page) for x, y in zip(a.parts, b.parts, strict=True)], a.plus or b.plus, a.optional or b.optional,
        common, a.fixed and b.fixed and (same_page or a.common == b.common), max(a.n, b.n) if same_page else a.n + b.n, a.chars + b.chars, a.link + b.link, a.blocks + b.blocks if same_page else [],
    )


def fold(nodes: list[Node], known: frozenset[tuple] = frozenset()) -> list[Node]:
    """``nodes`` with parts that follow each other again folded into one repeated part, innermost first.

    A stretch of nodes that repeats at once becomes a group; one whose keys are those of a ``known`` group becomes
    that group even where it stands once. Only lengths at which some node's key comes again, or that a known group has, are tried.
    """
    width, lengths = 0, {len(k) - 1 for k in known}
    while True:
        number: dict[tuple, int] = {}
        ids = [number.setdefault(x.key, len(number)) for x in nodes]
        last: dict[int, int] = {}
        gaps = set(lengths)
        for at, i in enumerate(ids):
            gaps.add(at - last.get(i, at))
            last[i] = at
        width = min((g for g in gaps if g > width), default=0)
        if not width or width > len(nodes):
            return nodes
        asked = {tuple(number.get(k, -1) for k in key[1:]) for key in known if len(key) - 1 == width}
        out: list[Node] = []
        at = 0
        while at + width <= len(nodes):
            end = at + width
            if end < len(ids) and ids[at] == ids[end]:
                stretch = ids[at:end]
                while ids[end : end + width] == stretch:
                    end += width
            if end == at + width and (width == 1 or tuple(ids[at:end]) not in asked):
                out.append(nodes[at])
                at += 1
                continue
            parts = nodes[at : at + width]
            for more in range(at + width, end, width):
                parts = [_joined(x, y, True) for x, y in zip(parts, nodes[more : more + width], strict=True)]
            if width == 1:
                parts[0].plus = True
                out += parts
            else:
                out.append(Node(parts=parts, plus=end > at + width, n=max(x.n for x in parts)))
            at = end
        nodes = out + nodes[at:]


def _groups(nodes: list[Node]) -> frozenset[tuple]:
    found = {x.key for x in nodes if x.parts}
    return frozenset(found.union(*(_groups(x.parts) for x in nodes if x.parts)))


def _slots(found: list[tuple[tuple[str, ...], str, int]]) -> list[Node]:
    """A page's blocks as text slots, each with the path of the elements open around it."""
    digest = lambda text: hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return [Node(path, common=frozenset((digest(text),)), chars=len(text), link=link, blocks=[i]) for i, (path, text, link) in enumerate(found)]


def _matches(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places of parts of equal keys, in order in both, by longest matching runs first."""
    runs = difflib.SequenceMatcher(None, [x.key for x in a], [x.key for x in b], autojunk=False).get_matching_blocks()
    return [(i + n, j + n) for i, j, size in runs for n in range(size)]


class Wrapper:
    """A union-free expression over token streams, built by aligning one page after another.

    A page is folded with the groups that the expression knows, and the expression with those of the page, so
    a group that repeats on one side only is a repeated group on both. Parts of equal keys then match along common
    runs; what one side lacks becomes an optional part, or an optional group if it is a run of them.
    """

    def __init__(self, nodes: list[Node] | None = None, whole: frozenset[tuple[str, ...]] = frozenset()) -> None:
        self.pages = 0
        self.nodes = nodes or []
        self.whole = whole  #: containers that hold all of the host's text, whatever they are called

    def align(self, page: list[Node]) -> None:
        page = fold(fold(page), _groups(self.nodes))
        a, b = fold(self.nodes, _groups(page)), page
        out: list[Node] = []
        at_i = at_j = 0
        for i, j in [*_matches(a, b), (len(a), len(b))]:
            out += _optional(a[at_i:i]) + (_optional(b[at_j:j]) if self.pages else b[at_j:j])
            if i < len(a):
                out.append(_joined(a[i], b[j], False))
            at_i, at_j = i + 1, j + 1
        self.nodes, self.pages = out, self.pages + 1

    def settle(self, least_pages: int = 3, region_share: float = 0.8, whole_share: float = 0.95, rescue_share: float = 0.25) -> None:
        """Label every slot ``main`` (in the host's main region), ``open`` (main where a page has no such region) or
        ``beside``, and keep as its ``common`` the template's texts alone.

        The slots' texts decide first: what stands in a slot on each of ``least_pages`` pages or more is template, and an
        open slot that is mostly links is beside, as is one in doubt that is mostly links or has one text. Names of containers tell what is left apart, but a
        container that holds ``whole_share`` of all varying text is no region beside it, whatever it is called, and where names leave
        less than ``rescue_share`` of the varying text, the container of most such text loses its mark, and the next, until they leave that much. Texts of a main
        region are template only in a slot that stands on every page, one page more than that at least, while slots with
        differing texts hold ``region_share`` of the region: so articles that a host repeats do not pass for a template.
        """
        slots = [s for node in self.nodes for s in node.slots()]
        varying = [s for s in slots if not s.fixed and 2 * s.link <= s.chars]
        mass: dict[tuple[str, ...], int] = {}
        for s in varying:
            for i in range(len(s.path) + 1):
                mass[s.path[:i]] = mass.get(s.path[:i], 0) + s.chars
        if self.pages >= least_pages:
            self.whole = frozenset(x for x, n in mass.items() if x and n >= whole_share * mass[()])
            while sum(s.chars for s in varying if _role(s.path, self.whole) != "beside") < rescue_share * mass.get((), 0):
                blamed: dict[tuple[str, ...], int] = {}
                for s in varying:
                    if at := _blamed(s.path, self.whole):
                        blamed[at] = blamed.get(at, 0) + s.chars
                if not blamed:
                    break
                self.whole |= {max(blamed, key=lambda x: (blamed[x], x))}
        roles = [_role(s.path, self.whole) for s in slots]
        if self.pages >= least_pages:
            roles = [role if role != "doubt" else "beside" if 2 * s.link > s.chars or (s.fixed and s.n >= least_pages) else "main" for s, role in zip(slots, roles, strict=True)]
        region = sum(s.chars for s, role in zip(slots, roles, strict=True) if role == "main")
        varied = sum(s.chars for s, role in zip(slots, roles, strict=True) if role == "main" and not s.fixed)
        for s, role in zip(slots, roles, strict=True):
            every = not s.optional and s.n == self.pages > least_pages and varied >= region_share * region
            if not (every if role == "main" else s.n >= least_pages):
                s.common = frozenset()
            s.label = "beside" if role == "open" and 2 * s.link > s.chars else role

    def read(self, page: list[tuple[tuple[str, ...], str, int]]) -> list[str]:
        """A label for each block of a page: that of the slot it matches, else what its containers say.

        An open block that is mostly a link, and that no slot is known for, stays between two blocks of its container that do.
        """
        nodes = _slots(page)
        digests = [x.common for x in nodes]
        labels = [""] * len(page)
        if self.nodes:
            folded = fold(fold(nodes), _groups(self.nodes))
            for i, j in _matches(self.nodes, folded):
                for slot, found in zip(self.nodes[i].slots(), folded[j].slots(), strict=True):
                    for at in found.blocks:
                        labels[at] = "beside" if digests[at] & slot.common else slot.label
        template = frozenset().union(*(s.common for node in self.nodes for s in node.slots()))
        linked = []
        for at, (path, text, link) in enumerate(page):
            if not labels[at]:
                role = _role(path, self.whole)
                if role == "open" and 2 * link > len(text):
                    linked.append(at)
                labels[at] = "beside" if role == "open" and (2 * link > len(text) or digests[at] & template) else role
            if labels[at] == "doubt":
                labels[at] = "main" if _reads_on(text, link) else "beside"
        for at in linked:
            near = [i for i in (at - 1, at + 1) if 0 <= i < len(page) and page[i][0] == page[at][0] and labels[i] == "open"]
            if len(near) == 2 and not digests[at] & template:
                labels[at] = "open"
        return labels

    def to_json(self) -> str:
        pack = lambda x: [list(x.path), [pack(y) for y in x.parts], sorted(x.common), x.label]
        return json.dumps([[pack(x) for x in self.nodes], sorted(map(list, self.whole))])

    @classmethod
    def from_json(cls, text: str) -> Wrapper:
        make = lambda x: Node(tuple(x[0]), [make(y) for y in x[1]], common=frozenset(x[2]), label=x[3])
        nodes, whole = json.loads(text)
        return cls([make(x) for x in nodes], frozenset(map(tuple, whole)))


def _optional(run: list[Node]) -> list[Node]:
    """A run of parts that the other side lacks, as one optional part."""
    fresh = [x for x in run if not x.optional]
    if len(run) < 2 or len(fresh) < len(run):
        for node in run:
            node.optional = True
        return run
    return [Node(parts=run, optional=True, n=max(x.n for x in run))]


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of a host's sample pages."""
    wrapper = Wrapper()
    for page in pages:
        wrapper.align(_slots(list(blocks(page))))
    wrapper.settle()
    return wrapper


def main_text(page: str, wrapper: Wrapper) -> str:
    """The main text of a page: its blocks that the host's wrapper labels main; if there are none, its open blocks.

    Where that leaves nothing, the container loses its mark that its class or id alone puts beside the text and that holds most text which reads as one.
    """
    found = list(blocks(page))
    labels = wrapper.read(found)
    if not {"main", "open"} & set(labels):
        blamed: dict[tuple[str, ...], int] = {}
        for path, text, link in found:
            if (at := _blamed(path, wrapper.whole)) and _reads_on(text, link):
                blamed[at] = blamed.get(at, 0) + len(text)
        if blamed:
            whole = wrapper.whole | {max(blamed, key=lambda x: (blamed[x], x))}
            labels = Wrapper(whole=whole).read(found)
    wanted = "main" if "main" in labels else "open"
    return "\n\n".join(text for (_, text, _), label in zip(found, labels, strict=True) if label == wanted)


def extract_main_text(df: DataFrame, *, url: str = "url", html: str = "html", out: str = "text", pages_per_host: int = 24) -> DataFrame:
    """``df`` with its html column replaced by ``out``, the main text of the whole page.

    From a bounded sample of each host, about ``pages_per_host`` pages by a hash of address and html (each
    html once, so that copies do not pass for a template), a wrapper is inferred; then every page is read whole and matched against
    its host's wrapper, whose slots decide what is main text. Blocks have their character references decoded and white space folded, and are joined by two
    line feeds. A null or blank page has the empty text. A null address, or one without a host, shares
    one wrapper with the others of that kind.

    Samples are drawn by hash with no exchange of pages but the sample's, so a host may hold any share of the pages. Wrappers (small tables of paths) are broadcast
    while they measure under 32 MB, and else joined by host, where adaptive execution splits a skewed one. Repeated rows give repeated rows; other columns are kept (``out`` replaces one
    of that name); an empty table gives no rows.
    """
    host, mark, name, plan = (free_name(df, x) for x in ("host", "mark", "name", "plan"))
    site = F.coalesce(F.lower(F.nullif(F.regexp_extract(col(url), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))), F.lit(""))
    keyed = df.withColumn(host, site)
    labelled = keyed.where(col(html).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(col(url), col(html)).alias("mark"), col(html).alias("html"))
    sample = hash_sample(labelled, F.col("host"), F.col("mark"), pages_per_host)
    sample = sample.withColumn("mark", F.xxhash64("html")).dropDuplicates(["host", "mark"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = pdf.sort_values("mark")["html"].tolist()
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "plan": [infer(pages).to_json()]})

    wrappers = materialise(sample.groupBy("host").applyInPandas(learn, "host string, plan string"))
    wrappers = broadcast_if_small(wrappers, F.octet_length("plan") + F.octet_length("host"))
    joined = keyed.join(wrappers.select(F.col("host").alias(name), F.col("plan").alias(plan)), keyed[host] == F.col(name), "left")
    rest = only_columns(df, drop=(html, out))
    lean = joined.select(*map(col, rest), col(html).alias(mark), F.col(plan).alias(plan))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper] = {None: Wrapper()}
        for batch in batches:
            texts = []
            for page, raw in zip(batch.column(len(rest)), batch.column(len(rest) + 1), strict=True):
                page, raw = page.as_py(), raw.as_py()
                if raw not in known:
                    if len(known) > 1000:
                        known = {None: Wrapper()}
                    known[raw] = Wrapper.from_json(raw)
                texts.append(main_text(page, known[raw]) if page else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, out])

    schema = T.StructType([*lean.schema.fields[: len(rest)], T.StructField(out, T.StringType())])
    return map_arrow(lean, read, schema)
