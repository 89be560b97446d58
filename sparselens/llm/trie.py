"""Prefix trie of conversations with a splitter skeleton.

A conversation is a path: one token of 20 bytes a turn, 16 of the SHA-256 of role and text and
4 of the text's length in UTF-8. Paths sorted as bytes stand in the order of a depth-first walk,
so a node's members are a contiguous range of (path, conv_id).

Splitters are drawn from a sample bounded in bytes and deal the paths into ranges, each finished
by one task. Only nodes that are prefixes of a splitter can have members in two ranges. These are
the skeleton, whose trie is broadcast. A range is sorted and walked once with a stack: a node off
the skeleton is finished there, a node on it yields a partial row. The partial rows are reduced
to one a skeleton node and rolled up towards the root. A splitter holds a conv_id where paths are
equal, so a group of copies is divided like any other range.

Memory: a task holds the rows of the open nodes of its range and one conversation's path (20 bytes
a turn). Ids of the members that end at a node are hashed in ascending order as they come; those of
a skeleton node travel as joined blocks and one task streams the blocks of a node, as a single
SHA-256 asks for.

Odd rows: a null role or text is empty; rows with a null ``conv_id`` belong to no conversation and
are left out; null turns come first, and equal turns are ordered by their token, so a repeated row
is a turn of its own and the result does not depend on the order of rows. An empty table gives no
node. Other columns are ignored. Very long texts are only hashed; very long conversations are
whole paths.
"""

import hashlib
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from sparselens.llm.common import staged

TOKEN, DIGEST = 20, 16
#: Conversations are rebuilt within families of this many neighbouring ids, from at most HEADS - 1 first turns.
FAMILY, HEADS = 5, 9
#: Bytes of paths a task walks, and bytes of sampled paths (and so of splitters) in the driver.
RANGE_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20
SAMPLES_A_RANGE, SAMPLE_TURNS = 20, 512
LOWEST = -1 << 63
BLOCK_IDS = 8_192
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
WALKED = f"{NODES}, skeleton int, parent_skeleton int, part int, block binary"
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_tokens(conversations):
    """(conv_id, turn, token): a turn as 20 bytes."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    token = F.concat(F.unhex(F.substring(F.sha2(named, 256), 1, 2 * DIGEST)),
                     F.unhex(F.lpad(F.hex(F.octet_length(text)), 2 * (TOKEN - DIGEST), "0")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", token.alias("token")).where(
        "conv_id is not null")


def _paths(tokens, path_of):
    """Tokens in order of (family, late, conv_id, turn) to (conv_id, path); ``path_of(conv, family,
    heads, own, first)`` makes a path from a conversation's own turns and the family's first ones."""
    def run(batches):
        now, first, held = None, (None, b""), []  # the open conversation, the head of the last family
        out, size = [], 0
        for batch in batches:
            family, conv, heads = (batch.column(k).to_pylist() for k in range(3))
            column = batch.column(3)
            raw = b"".join(column.to_pylist())
            cuts = [0, *(k for k in range(1, len(conv)) if conv[k] != conv[k - 1]), len(conv)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if now is not None and now[0] != conv[lo]:
                    path, first = path_of(*now, b"".join(held), first)
                    out.append((now[0], path))
                    size += len(path)
                    held.clear()
                now = (conv[lo], family[lo], heads[lo])
                held.append(raw[TOKEN * lo:TOKEN * hi])
            if size > 4 << 20 or len(out) > 50_000:
                yield rows(out)
                out, size = [], 0
        if now is not None:
            out.append((now[0], path_of(*now, b"".join(held), first)[0]))
        yield rows(out)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())],
                                          ["conv_id", "path"])

    order = ["family", "late", "conv_id", F.col("turn").asc_nulls_first(), "token"]
    return (tokens.repartition("family").sortWithinPartitions(*order)
            .select("family", "conv_id", "heads", "token").mapInArrow(run, "conv_id long, path binary"))


def conversation_paths(conversations):
    """(conv_id, path) of the conversations as they are."""
    own = turn_tokens(conversations).select("*", F.col("conv_id").alias("family"), F.lit(False).alias("late"), F.lit(0).alias("heads"))
    return _paths(own, lambda conv, family, heads, own, first: (own, first))


def rebuilt_paths(conversations):
    """(conv_id, path) of the rebuilt conversations: the first h turns of conversation c - c % 5, then
    the own turns after the first h; h is crc32(c) % 9. A family meets in one task, its first member first."""
    def rebuilt(conv, family, heads, own, first):
        if conv == family:
            first = (family, own[:(HEADS - 1) * TOKEN])
            return own, first
        head = first[1] if first[0] == family else b""
        return head[:heads * TOKEN] + own[heads * TOKEN:], first

    conv = F.col("conv_id")
    tokens = turn_tokens(conversations).withColumns({
        "family": conv - conv % FAMILY, "heads": (F.crc32(conv.cast("string")) % HEADS).cast("int")})
    return _paths(tokens.withColumn("late", F.expr("conv_id <> family")), rebuilt)


def shared_turns(a, b):
    """The number of first turns two paths have in common."""
    lo, hi = 0, min(len(a), len(b)) // TOKEN
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid * TOKEN] == b[:mid * TOKEN] else (lo, mid - 1)
    return lo


def choose_splitters(sample, ranges):
    """At most ``ranges - 1`` splitters (path, conv_id) that cut the sorted sample into even weights.

    A splitter is the shortest prefix that parts two neighbours, or the whole pair where paths are equal.
    """
    sample = sorted(sample)
    total, sofar, cuts = sum(len(p) + TOKEN for p, _ in sample), 0, []
    for before, (path, conv) in zip(sample, sample[1:]):
        sofar += len(before[0]) + TOKEN
        if sofar * ranges >= total * (len(cuts) + 1) and len(cuts) < ranges - 1:
            same = path == before[0]
            cuts.append((path, conv) if same else (path[:(shared_turns(before[0], path) + 1) * TOKEN], LOWEST))
    return sorted(set(cuts))


class Skeleton:
    """The trie of the splitters' paths: ``child[node, token]``, node 0 is the root."""

    def __init__(self, splitters):
        self.splitters, self.child, self.parent, self.tokens = splitters, {}, [None], [b""]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), TOKEN):
                key = (node, path[at:at + TOKEN])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(node)
                    self.tokens.append(key[1])
                node = self.child[key]


class Node:
    """An open node of a walk. ``mark`` is its skeleton number or -1."""
    __slots__ = ("mark", "token", "least", "convs", "children", "leaves", "saved", "ends", "digest", "pending", "blocks")

    def __init__(self, mark, token):
        self.mark, self.token, self.least = mark, token, None
        self.convs = self.children = self.leaves = self.saved = self.blocks = 0
        self.ends, self.digest, self.pending = [], None, []


def saving(token, convs):
    return (convs - 1) * int.from_bytes(token[DIGEST:], "big")


def walk(rows, child, part):
    """Rows of WALKED for one range of sorted (conv_id, path)."""
    stack, last = [Node(0, b"")], b""

    def flush(node):
        """Ends gathered so far go into the node's hash, or out as a block of a skeleton node."""
        text = ",".join(map(str, node.ends)).encode()
        node.ends.clear()
        if node.mark >= 0:
            row = (None, node.blocks) + (None,) * 6 + (node.mark, None, part, text)
            node.blocks += 1
            return [row]
        if node.digest is None:
            node.digest = hashlib.sha256(text)
        else:
            node.digest.update(b"," + text)
        return []

    def close():
        node, depth = stack.pop(), len(stack)
        out = flush(node) if node.ends else []
        up = stack[-1] if stack else None
        if up is not None:
            up.convs += node.convs
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.mark >= 0:  # partial: what stands below it off the skeleton
            out.append((node.least, depth, None, node.convs, node.children, node.leaves, node.saved, None, node.mark, None, None, None))
            return out
        node.saved += saving(node.token, node.convs)
        node.leaves = node.leaves or 1
        out += [(*kid[:2], node.least, *kid[3:]) for kid in node.pending]
        ends = node.digest.hexdigest() if node.digest else EMPTY
        row = (node.least, depth, None, node.convs, node.children, node.leaves, node.saved, ends, None, None, None, None)
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        if up.mark >= 0:
            out.append((*row[:9], up.mark, None, None))
        else:
            up.pending.append(row)
        return out

    for conv, path in rows:
        if path != last:
            keep = shared_turns(last, path)
            while len(stack) > keep + 1:
                yield from close()
            for at in range(keep * TOKEN, len(path), TOKEN):
                token = path[at:at + TOKEN]
                mark = stack[-1].mark
                stack.append(Node(child.get((mark, token), -1) if mark >= 0 else -1, token))
            last = path
        top = stack[-1]
        top.convs += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.ends.append(conv)
        if len(top.ends) >= BLOCK_IDS:
            yield from flush(top)
    if last or stack[0].convs:
        while stack:
            yield from close()


def _walked(paths, splitters, ranges):
    """Deals paths to their ranges and walks each one."""
    child = paths.sparkSession.sparkContext.broadcast((splitters, Skeleton(splitters).child))
    columns = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t])
                         for n, t in (c.split() for c in WALKED.split(", "))])

    def deal(batches):
        cuts = child.value[0]
        for batch in batches:
            at = [bisect_right(cuts, (p, c)) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], ["conv_id", "path", "part"])

    def run(batches):
        def rows(part):
            """Rows of one range; the first row of the next one stays behind in ``ahead``."""
            while ahead and ahead[0][2] == part:
                yield ahead[0][:2]
                ahead[:] = next(stream, ())

        stream = ([r] for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3))))
        ahead, out = list(next(stream, ())), []
        while ahead:
            part = ahead[0][2]
            for row in walk(rows(part), child.value[1], part):
                out.append(row)
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), columns)]
                                          if out else [pa.array([], f.type) for f in columns], schema=columns)

    return (paths.mapInArrow(deal, "conv_id long, path binary, part int").repartitionById(ranges, F.col("part"))
            .sortWithinPartitions("part", "path", "conv_id").mapInArrow(run, WALKED))


def _hashed(blocks):
    """(skeleton, ends_sha256): the joined ids of each skeleton node, streamed in the order of ranges."""
    def run(batches):
        now, digest, out = None, None, []
        for batch in batches:
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if mark == now:
                    digest.update(b"," + text)
                    continue
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = mark, hashlib.sha256(text)
        if now is not None:
            out.append((now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in out], pa.int32()), pa.array([d for _, d in out], pa.string())],
                                         ["skeleton", "ends_sha256"])

    return (blocks.repartition("skeleton").sortWithinPartitions("skeleton", "part", "depth").select("skeleton", "block")
            .mapInArrow(run, "skeleton int, ends_sha256 string"))


def _rolled_up(skeleton, partial, ends):
    """Whole rows of the skeleton's nodes from their reduced partial rows, deepest first."""
    rows, below = {}, defaultdict(lambda: [0, 0, 0])
    for mark in sorted(partial, key=lambda m: -partial[m]["depth"]):
        p, (children, leaves, saved) = partial[mark], below[mark]
        children, leaves, saved = children + p["n_children"], leaves + p["n_leaves"], saved + p["saved_tokens"]
        leaves = leaves or 1
        up = skeleton.parent[mark]
        if up is not None:
            saved += saving(skeleton.tokens[mark], p["n_convs"])
            for k, v in enumerate((1, leaves, saved)):
                below[up][k] += v
        rows[mark] = [p["conv_id"], p["depth"], None if up is None else partial[up]["conv_id"], p["n_convs"], children, leaves,
                      saved, ends.get(mark, EMPTY), mark]
    return [tuple(r) for r in rows.values()]


def prefix_trie(paths, ranges=None):
    """One row a node of the trie of ``paths`` (conv_id, path): see NODES and the module's text.

    conv_id is the smallest member, parent_conv_id the parent's; n_convs members; n_leaves childless
    nodes of the subtree; saved_tokens sums (members - 1) x bytes of the last text over the subtree;
    ends_sha256 hashes the ids of members that end here, ascending, comma-joined.
    ``ranges`` is the number of ranges; by default it follows the bytes of all paths.
    """
    spark = paths.sparkSession
    paths = staged(paths, "paths")
    cut = F.expr(f"substring(path, 1, {SAMPLE_TURNS * TOKEN})")
    total = paths.agg(F.count("*"), F.sum(F.length("path") + TOKEN), F.sum(F.length(cut) + TOKEN)).first()
    if not total[0]:
        return spark.createDataFrame([], NODES)
    ranges = ranges or max(2 * spark.sparkContext.defaultParallelism, -(-total[1] // RANGE_BYTES))
    share = min(1.0, SAMPLES_A_RANGE * ranges / total[0], SAMPLE_BYTES / total[2])
    drawn = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = [(bytes(r[0]), r[1]) for r in drawn.select(cut, "conv_id").collect()]
    splitters = choose_splitters(sample, ranges)
    skeleton = Skeleton(splitters)
    walked = staged(_walked(paths, splitters, len(splitters) + 1), "walked")

    parts = (walked.where("skeleton is not null and part is null").groupBy("skeleton")
             .agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
                  *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))))
    ends = dict(_hashed(walked.where("part is not null")).collect())  # at most one row a skeleton node, as below
    rows = _rolled_up(skeleton, {r["skeleton"]: r for r in parts.collect()}, ends)
    spine = spark.createDataFrame(rows, f"{NODES}, mark int")
    up = F.broadcast(spine.select(F.col("mark").alias("parent_skeleton"), F.col("conv_id").alias("up")))
    columns = [c.split()[0] for c in NODES.split(", ")]
    rest = walked.where("skeleton is null").join(up, "parent_skeleton", "left").withColumn(
        "parent_conv_id", F.coalesce("up", "parent_conv_id"))
    return spine.select(columns).unionByName(rest.select(columns))


def oracle():
    """The trie of the rebuilt conversations in SQL; crc32 is worked out bit by bit."""
    return """
    with turns as (
        select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos,
               coalesce(role, '') as role, coalesce(text, '') as text
        from conversations where conv_id is not null),
    ids as (
        select distinct conv_id, conv_id - conv_id % 5 as first_id,
               xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
                       string_split(conv_id::varchar, ''), lambda ch: [ascii(ch)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) % 9 as h
        from turns),
    rebuilt as (
        select i.conv_id, t.pos as part_pos, 0 as part, t.role, t.text
        from ids i join turns t on t.conv_id = i.first_id where t.pos < i.h
        union all
        select i.conv_id, t.pos, 1, t.role, t.text from ids i join turns t using (conv_id) where t.pos >= i.h),
    steps as (
        select conv_id, row_number() over w as depth, strlen(text) as bytes,
               string_agg(md5(strlen(role)::varchar || ':' || role || text), '') over w as node
        from rebuilt window w as (partition by conv_id order by part, part_pos rows unbounded preceding)
        union all select conv_id, 0, 0, '' from ids),
    lengths as (select conv_id, max(depth) as len from steps group by conv_id),
    members as (
        select s.node, s.depth, min(s.conv_id) as conv_id, count(*) as n_convs, max(s.bytes) as bytes,
               sha256(coalesce(string_agg(s.conv_id::varchar, ',' order by s.conv_id) filter (where l.len = s.depth), '')) as ends_sha256
        from steps s join lengths l using (conv_id) group by s.node, s.depth),
    parents as (
        select c.node, p.node as up, p.conv_id as parent_conv_id
        from members c join steps s on s.conv_id = c.conv_id and s.depth = c.depth - 1 join members p on p.node = s.node),
    kids as (select up as node, count(*) as n_children from parents group by up),
    below as (select distinct a.node, b.node as sub from steps a join steps b on a.conv_id = b.conv_id and b.depth >= a.depth),
    sums as (
        select b.node, count(*) filter (where k.node is null) as n_leaves, sum((m.n_convs - 1) * m.bytes)::bigint as saved_tokens
        from below b join members m on m.node = b.sub left join kids k on k.node = b.sub group by b.node)
    select m.conv_id, m.depth, p.parent_conv_id, m.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves,
           s.saved_tokens, m.ends_sha256
    from members m left join parents p using (node) left join kids k using (node) join sums s using (node)
    """
