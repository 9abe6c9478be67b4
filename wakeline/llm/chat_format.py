"""Chat formatting with a prefix tree (operator 6).

Conversations that share their first turns share the tokens of those turns. Distinct conversations are sorted by the path of their turns'
digests, so that those with the longest common beginnings are neighbours, and cut into segments of bounded size; a segment is one
prefix tree, written depth-first: every turn once, with

* token_ids and loss_mask (1 on the text of assistant turns),
* position_ids: the place of a token in its own conversation, as if nothing were shared,
* nodes: for every turn its interval of tokens and its parent. A token attends to its own turn up to itself and to the whole intervals of
  all ancestors; `attends` lists those intervals, joined where one ends at the start of the next.

A beginning that many conversations share is written once a segment, never all in one task. Neighbours are merged only where role and text
of a turn are equal, not just their digests.

Texts cross the network twice, packed: the turns of a conversation that stand together in a file are one zstandard block from the start.
A task sends each distinct conversation on only once, so copies of one conversation never meet in large numbers.

Template: <|turn|>ROLE newline TEXT<|end|> newline. Inside roles and texts a backslash is doubled, and a control string gets a backslash after its
first character; in roles a newline gets one before it. Reading drops each such backslash, which gives back any text.

Defined results: turns are ordered by turn (nulls last), then role, then text; null roles and texts count as empty; rows without a conversation
id belong to one conversation whose id is null; repeated rows are turns of their own; conversations of equal turns are written once and read
back for each id; a very long text is one turn like any other, and a segment is closed after the conversation that fills it; an
empty table gives no segments; further columns are ignored, whatever their names. All turns of one conversation meet in one task, as
its digests and its place in the tree run over all of them in order.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, text_batches

#: Strings that mark turns here or in other templates, and so are escaped inside texts.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURN, END = "<|turn|>", "<|end|>\n"
LOSS_ROLE = "assistant"
#: Bytes of each turn's digest in a path.
STEP = 16


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    if "<" in text or "[" in text:
        for c in CONTROL:
            text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _tokenizer(path: str) -> tuple[Callable[[str], np.ndarray], Callable[[np.ndarray], str]]:
    """Encode and decode, loaded once a Python worker. Control strings are ordinary text to either library."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        model = tiktoken.Encoding("wakeline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda s: model.encode_to_numpy(s, disallowed_special=()).astype(np.int32), lambda ids: model.decode(ids.tolist())
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda s: np.array(model.encode(s, add_special_tokens=False).ids, np.int32), lambda ids: model.decode(ids.tolist(), skip_special_tokens=False)


# ---------------------------------------------------------------- rows to paths
def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=1)


def _unpacker():
    import zstandard

    one = zstandard.ZstdDecompressor()
    return lambda block: pickle.loads(one.decompress(block))


def _order(turn: tuple) -> tuple:
    at, role, text = turn
    return (at is None, at if at is not None else 0, role, text)


def _pack(most: int = 1 << 20):
    """Turns of one conversation that stand together -> one block of at most about `most` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _packer()
        for batch in batches:
            at: list[int] = []
            blocks: list[bytes] = []
            turns: list[tuple] = []
            ids, size = batch.column(0).to_pylist(), 0
            for i, (turn, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if turns and (ids[i] != ids[at[-1]] or size > most):
                    blocks.append(packer.compress(pickle.dumps(turns, 5)))
                    turns, size = [], 0
                if not turns:
                    at.append(i)
                turns.append((turn, role or "", text or ""))
                size += len(text or "")
            if turns:
                blocks.append(packer.compress(pickle.dumps(turns, 5)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(blocks, pa.binary())], names=["conv_id", "block"])

    return run


def _walk(turns: list[tuple]) -> list[bytes]:
    """Each turn's digest covers the digest before it, so equal paths mean equal beginnings."""
    path, last = [], b""
    for _, role, text in turns:
        last = hashlib.sha256(b"%s/%d:%s%s" % (last, len(role), role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass"))).digest()
        path.append(last)
    return path


def _sorted_turns(unpack, blocks: list[bytes]) -> tuple[list[tuple], bool]:
    """All turns in order, and whether the first block has just these."""
    turns = [t for b in blocks for t in unpack(b)]
    ordered = sorted(turns, key=_order)
    return ordered, len(blocks) == 1 and ordered == turns


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = _unpacker()
    for batch in batches:
        digests = [_walk(_sorted_turns(unpack, blocks)[0])[-1].hex() for blocks in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["conv_id", "digest"])


def _paths(remember: int = 200_000):
    """Distinct conversations of a task, each once (unless it has seen very many others since)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, unpack, seen = _packer(), _unpacker(), set()
        for batch in batches:
            rows: list[tuple] = []
            for blocks in batch.column(0).to_pylist():
                turns, as_sent = _sorted_turns(unpack, blocks)
                path = _walk(turns)
                if path[-1] not in seen:
                    if len(seen) >= remember:
                        seen.clear()
                    seen.add(path[-1])
                    rows.append((path[-1].hex(), b"".join(step[:STEP] for step in path), blocks[0] if as_sent else packer.compress(pickle.dumps(turns, 5))))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["digest", "path", "turns"])

    return run


def conversation_blocks(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, blocks (packed turns): a row a conversation."""
    text_batches(rows.sparkSession)
    turns = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(_pack(), f"conv_id {kind}, block binary").groupBy("conv_id").agg(F.collect_list("block").alias("blocks"))


# ---------------------------------------------------------------- paths to segments
class _Tree:
    """One segment while it is being written."""

    def __init__(self, encode):
        self.encode = encode
        self.n = 0
        self.tokens: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.mask: list[np.ndarray] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.branch: list[tuple[bytes, tuple, int]] = []  # digest, turn and node of each turn of the last conversation

    def add(self, path: bytes, digest: str, turns: list[tuple]) -> None:
        steps = [path[i : i + STEP] for i in range(0, len(path), STEP)]
        shared = 0
        while shared < min(len(self.branch), len(steps)) and self.branch[shared][0] == steps[shared] and self.branch[shared][1] == turns[shared]:
            shared += 1
        del self.branch[shared:]
        for step, (role, text) in zip(steps[shared:], turns[shared:], strict=True):
            parent = self.nodes[self.branch[-1][2]] if self.branch else None
            at = parent["position"] + parent["end"] - parent["start"] if parent else 0
            head, body, tail = self._frame(role), self.encode(escape(text)), self._tail()
            n = len(head) + len(body) + len(tail)
            self.tokens += (head, body, tail)
            self.positions.append(np.arange(at, at + n, dtype=np.int32))
            self.mask += (np.zeros(len(head), np.int8), np.full(len(body), role == LOSS_ROLE, np.int8), np.zeros(len(tail), np.int8))
            attends = []
            if parent:
                attends = list(parent["attends"])
                if attends and attends[-1]["end"] == parent["start"]:
                    attends[-1] = {"start": attends[-1]["start"], "end": parent["end"]}
                else:
                    attends.append({"start": parent["start"], "end": parent["end"]})
            self.nodes.append({"start": self.n, "end": self.n + n, "parent": self.branch[-1][2] if parent else -1, "position": at, "attends": attends})
            self.n += n
            self.branch.append((step, (role, text), len(self.nodes) - 1))
        self.leaves.append({"digest": digest, "node": self.branch[-1][2]})

    def _frame(self, role: str) -> np.ndarray:
        return _head(self.encode, escape(role).replace("\n", "\\\n"))

    def _tail(self) -> np.ndarray:
        return _piece(self.encode, END)


@functools.lru_cache(maxsize=1024)
def _piece(encode, text: str) -> np.ndarray:
    return encode(text)


def _head(encode, role: str) -> np.ndarray:
    return _piece(encode, f"{TURN}{role}\n") if len(role) < 100 else encode(f"{TURN}{role}\n")


_INTERVAL = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_NODES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("attends", _INTERVAL)]))
_LEAVES = pa.list_(pa.struct([("digest", pa.string()), ("node", pa.int32())]))
SEGMENTS = "token_ids array<int>, loss_mask array<tinyint>, position_ids array<int>, nodes array<struct<start: int, end: int, parent: int, position: int, attends: array<struct<start: int, end: int>>>>, leaves array<struct<digest: string, node: int>>"


def _write(tokenizer: str, most_tokens: int, most_leaves: int, at_once: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = _tokenizer(tokenizer)
        unpack = _unpacker()

        def rows(trees: list[_Tree]) -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *(t.n for t in trees)]).astype(np.int32))
            flat = [np.concatenate([x for t in trees for x in getattr(t, c)]) for c in ("tokens", "mask", "positions")]
            cols = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]
            cols += [pa.array([t.nodes for t in trees], _NODES), pa.array([t.leaves for t in trees], _LEAVES)]
            return pa.RecordBatch.from_arrays(cols, names=["token_ids", "loss_mask", "position_ids", "nodes", "leaves"])

        tree, full, held, last = _Tree(encode), [], 0, None
        for batch in batches:
            for digest, path, block in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                turns = [turn[1:] for turn in unpack(block)]
                if last == (digest, turns):
                    continue  # an equal conversation from another task
                last = digest, turns
                if tree.leaves and (tree.n >= most_tokens or len(tree.leaves) >= most_leaves or tree.branch[0][0] != path[:STEP]):
                    full.append(tree)
                    held += tree.n
                    tree = _Tree(encode)
                    if len(full) >= at_once or held >= 8 * most_tokens:
                        yield rows(full)
                        full, held = [], 0
                tree.add(path, digest, turns)
        if tree.leaves:
            full.append(tree)
        if full:
            yield rows(full)

    return run


def prefix_tree_segments(blocks: DataFrame, tokenizer: str | None = None, most_tokens: int = 32_768, most_leaves: int = 1024) -> DataFrame:
    """Segments of the distinct conversations among blocks (see conversation_blocks)."""
    paths = blocks.select("blocks").mapInArrow(_paths(), "digest string, path binary, turns binary")
    ordered = paths.repartitionByRange(parts(blocks.sparkSession), "path").sortWithinPartitions("path", "digest")
    return ordered.mapInArrow(_write(tokenizer or default_tokenizer(), most_tokens, most_leaves), SEGMENTS)


# ---------------------------------------------------------------- reading back
_TURN = re.compile(r"((?:\\.|[^\\\n])*)\n(.*)\Z", re.DOTALL)


def _read(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = _tokenizer(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                ids, mask = batch.column(0)[i].values.to_numpy(), batch.column(1)[i].values.to_numpy().astype(bool)
                nodes = batch.column(3)[i].as_py()
                said, losses, sizes = [], [], []
                for n in nodes:
                    own, on = ids[n["start"] : n["end"]], mask[n["start"] : n["end"]]
                    formatted = decode(own)
                    turns = formatted.split(TURN)
                    if len(turns) != 2 or turns[0] or not formatted.endswith(END):
                        raise ValueError("a node is not one turn")
                    role, text = _TURN.match(turns[1][: -len(END)]).groups()
                    said.append(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                    losses.append(unescape(decode(own[on])) if on.any() else "")
                    sizes.append(len(formatted))
                for leaf in batch.column(4)[i].as_py():
                    chain, node = [], leaf["node"]
                    while node >= 0:
                        chain.append(node)
                        node = nodes[node]["parent"]
                    chain.reverse()
                    digest, loss = hashlib.sha256(), hashlib.sha256()
                    for node in chain:
                        digest.update(said[node])
                        loss.update(losses[node].encode("utf-8", "surrogatepass"))
                    out.append((leaf["digest"], len(chain), digest.hexdigest(), sum(len(losses[n]) for n in chain), loss.hexdigest(), sum(sizes[n] for n in chain)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["digest", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(segments: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Decode segments and follow each leaf to its root: digests of what every conversation says and of what it is trained on."""
    schema = "digest string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return segments.mapInArrow(_read(tokenizer or default_tokenizer()), schema)


def format_chats(rows: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments, and which conversation (conv_id) is which leaf (digest). Nothing is written; write both where they are used more than once."""
    blocks = conversation_blocks(rows)
    kind = blocks.schema["conv_id"].dataType.simpleString()
    return prefix_tree_segments(blocks, tokenizer), blocks.mapInArrow(_leaves, f"conv_id {kind}, digest string")
