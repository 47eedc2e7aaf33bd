"""The load path of one workflow inside a task. It gives what plans.load does with joins, for workflows that a task can hold."""

from __future__ import annotations

import gc
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from operator import lt
from typing import NamedTuple

import pyarrow as pa

from pipelake.functions.exprs import WHITE_SPACE

LAST = (1 << 31) - 1
# Bits of a row's flags. LOCAL: its workflow may be loaded here; DECLARES: its workflow declares a dependency.
BLANK_TOOL, NO_INPUT, NO_OUTPUT, DECLARES, LOCAL = 1, 2, 4, 8, 16
SLASHES = re.compile("/+(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)")


class Step(NamedTuple):
    """A step as scanned. names: those in braces of a step that expands; flags: the bits above; ins and outs: its files, where its workflow declares no dependency."""

    ordinal: int | None
    step_id: str | None
    previous: list
    next: list
    names: list
    command: str | None
    flags: int
    ins: list | None
    outs: list | None
    files: list | None


class Loaded(NamedTuple):
    """steps(at, value_pos, value, step_id, previous, next, command), order(level, position) of each, errors(stage, step_id, rule, detail), warnings(step_id, rule, detail)."""

    steps: list
    order: list
    errors: list
    warnings: list


def _low(value) -> tuple:
    """A key that puts null first."""
    return value is not None, value


def _stops(stage: str, step_id, rule: str, detail) -> Loaded:
    return Loaded([], [], [(stage, step_id, rule, detail)], [])


def _unmet(known: set, steps: list[Step]) -> bool:
    for s in steps:
        if not (known.issuperset(s.previous) and known.issuperset(s.next)):
            return True
    return False


def _declared_error(steps: list[Step]) -> Loaded | None:
    known = {s.step_id for s in steps}
    known.discard(None)
    if not _unmet(known, steps):
        return None
    _, side, _, step_id, ref = min(
        (_low(s.ordinal), side, at, _low(s.step_id), _low(ref))
        for s in steps for side, refs in enumerate((s.previous, s.next)) for at, ref in enumerate(refs) if ref not in known
    )
    return _stops("dependencies", step_id[1], ("unknown_dependency", "unknown_dependent")[side], ref[1])


def _producer_error(steps: list[Step]) -> Loaded | None:
    by_file = defaultdict(list)
    for s in steps:
        for pos, file in enumerate(s.outs or ()):
            by_file[file].append((_low(s.ordinal), pos, _low(s.step_id)))
    again = []
    for file, found in by_file.items():
        if len(found) > 1:
            found.sort()
            again.append((*found[1], file, found[0][2]))
    if not again:
        return None
    _, _, second, file, first = min(again)
    return _stops("dependencies", second[1], "multiple_producers", " ".join(t for t in (file, "from", first[1], "and", second[1]) if t is not None))


def _derived(steps: list[Step]) -> list[Step]:
    """The steps with previous and next from files, as edges.populate_dependencies fills them."""
    writers = defaultdict(set)
    for s in steps:
        for file in s.outs or ():
            writers[file].add(s.step_id)
    before, after = defaultdict(set), defaultdict(set)
    for s in steps:
        for file in s.ins or ():
            for src in writers.get(file, ()):
                before[s.step_id].add(src)
                after[src].add(s.step_id)
    if not before:
        return steps
    filled = lambda refs, own: sorted(r for r in refs if r is not None) if own is not None and refs else []
    return [s._replace(previous=filled(before.get(s.step_id), s.step_id), next=filled(after.get(s.step_id), s.step_id)) for s in steps]


def _stem(file: str) -> tuple[str | None, str, str]:
    """(extension, stem, name) of a path, as exprs.path_part gives them in posix style."""
    name = SLASHES.sub("", file).rsplit("/", 1)[-1] if "/" in file else file
    dot = name.rfind(".")
    return (name[dot + 1 :], name[:dot], name) if dot > 0 and name != ".." else (None, name, name)


def _values(steps: list[Step], wanted: set[str]) -> dict[str, list[str]]:
    """The sample values of each wanted name that has files, or a list without any."""
    files = defaultdict(set)
    for s in steps:
        for name, found in s.files or ():
            if name in wanted:
                files[name].update(f for f in found or () if f is not None)
    values = {}
    for name, found in files.items():
        parts = [_stem(f) for f in sorted(found)]
        values[name] = [p[1] if len({p[0] for p in parts} - {None}) == 1 else p[2] for p in parts]
    return values


def _fans(steps: list[Step], values: dict[str, list[str]]) -> dict[str, list[str]]:
    """The instances of each id of these steps, all of which expand."""
    of_id = defaultdict(list)
    for s in steps:
        if s.step_id is not None:
            of_id[s.step_id].append((_low(s.ordinal), [f"{s.step_id}_{v}" for v in values[s.names[0]]]))
    return {step_id: list(dict.fromkeys(rows[0][1] if len(rows) == 1 else (i for _, found in sorted(rows) for i in found))) for step_id, rows in of_id.items()}


def _expanded(steps: list[Step], mode: str, most: int) -> list | Loaded | None:
    """(at, value_pos, value, step_id, previous, next, command) of all instances, the error that stops the load, or None if there are more than ``most``."""
    named = [s for s in steps if s.names]
    if not named:
        return [(at, 0, None, s.step_id, s.previous, s.next, s.command) for at, s in enumerate(steps)]
    values = _values(steps, {s.names[0] for s in named if len(s.names) == 1})
    stuck = [(_low(s.ordinal), _low(s.step_id), "more than one name" if len(s.names) > 1 else "no file mapping") for s in named if len(s.names) > 1 or s.names[0] not in values]
    if stuck:
        _, step_id, error = min(stuck)
        return _stops("expansion", step_id[1], "not_expandable", error)
    if sum(len(values[s.names[0]]) * (1 + len(s.previous) + len(s.next)) for s in named) > most:
        return None
    fans = _fans(named, values) if mode == "resolve" else {}
    if fans and sum(len(fans.get(ref, ())) for s in steps if not s.names for ref in (*s.previous, *s.next)) > most:
        return None
    found = []
    for at, s in enumerate(steps):
        if not s.names:
            sides = [[i for ref in refs for i in fans.get(ref, (ref,))] if refs else refs for refs in (s.previous, s.next)]
            found.append((at, 0, None, s.step_id, *sides, s.command))
            continue
        mark = "{" + s.names[0] + "}"
        for pos, value in enumerate(values[s.names[0]]):
            if mode == "resolve":
                sides = [[f"{ref}_{value}" if ref in fans else ref for ref in refs] if refs else refs for refs in (s.previous, s.next)]
            else:
                sides = [[f"{ref}_{value}" if ref is not None else value for ref in refs] for refs in (s.previous, s.next)]
            found.append((at, pos, value, f"{s.step_id}_{value}" if s.step_id is not None else value, *sides, s.command and s.command.replace(mark, value)))
    return found


def _ordered(found: list[tuple], keys: list) -> list[tuple[int, int] | None]:
    """(level, position) of each step of ``found``, whose ids differ, or None in or behind a cycle; see graph.declared_links and graph.topological."""
    index = {f[3]: k for k, f in enumerate(found)}
    index.pop(None, None)
    needed: list[int] = [0] * len(found)
    out: list[list] = [[] for _ in found]
    listed = set()
    for j, f in enumerate(found):
        for place, dst in enumerate(f[5]):
            k = index.get(dst)
            if k is not None and (f[3], k) not in listed:
                listed.add((f[3], k))
                needed[k] += 1
                if f[3] is not None:
                    out[j].append((k, place))
    for k, f in enumerate(found):
        before = f[4]
        if before and f[3] is not None:
            for src in before if len(before) == 1 else dict.fromkeys(before):
                if not listed or (src, k) not in listed:
                    needed[k] += 1
                    j = index.get(src)
                    if j is not None:
                        out[j].append((k, LAST))
    order: list[tuple[int, int] | None] = [None] * len(found)
    here = [k for _, k in sorted([(keys[k], k) for k, n in enumerate(needed) if not n])]
    level = position = 0
    while here:
        below = []
        for k in here:
            position += 1
            order[k] = (level, position)
            for dst, place in out[k]:
                needed[dst] -= 1
                if not needed[dst]:
                    below.append((position, place, keys[dst], dst))
        if len(below) > 1:
            below.sort()
        here = [b[3] for b in below]
        level += 1
    return order


def load_one(steps: list[Step], mode: str = "resolve", most: int = 100_000) -> Loaded | None:
    """The load of one workflow, or None where its expansion has more than ``most`` steps and references."""
    declares = steps[0].flags & DECLARES
    stopped = _declared_error(steps) if declares else _producer_error(steps)
    if stopped:
        return stopped
    found = _expanded(steps if declares else _derived(steps), mode, most)
    if not isinstance(found, list):
        return found
    if not found:
        return _stops("validation", None, "empty_workflow", None)
    known = {f[3] for f in found}
    ordinals = [s.ordinal for s in steps]
    if None not in ordinals and all(map(lt, ordinals, ordinals[1:])):
        keys = list(range(len(found)))
    else:
        keys = [((o := steps[f[0]].ordinal) is not None, o, f[1] if o is not None else 0, *_low(f[3])) for f in found]
    if len(known) < len(found):
        seen = set()
        for step_id in (found[k][3] for _, k in sorted(zip(keys, range(len(found))))):
            if step_id in seen:
                return _stops("validation", step_id, "duplicate_id", None)
            seen.add(step_id)
    known.discard(None)
    errors, warnings = [], []
    for at, _, _, step_id, before, following, command in found:
        flags = steps[at].flags
        if not step_id or not step_id.strip(WHITE_SPACE):
            errors.append(("validation", step_id, "blank_id", None))
        else:
            if flags & BLANK_TOOL:
                errors.append(("validation", step_id, "blank_tool", None))
            if not command or not command.strip(WHITE_SPACE):
                errors.append(("validation", step_id, "blank_command", None))
            elif flags & (NO_INPUT | NO_OUTPUT) and "{" in command:
                warnings.extend((step_id, f"{side}_placeholder_without_{side}", None) for flag, side in ((NO_INPUT, "input"), (NO_OUTPUT, "output")) if flags & flag and "{" + side + "}" in command)
        for refs, rule in ((before, "unknown_previous"), (following, "unknown_next")):
            if refs and not known.issuperset(refs):
                errors.extend(("validation", step_id, rule, ref) for ref in refs if ref not in known)
    order = _ordered(found, keys)
    if None in order:
        errors.append(("validation", None, "cycle", None))
    return Loaded([], [], errors, warnings) if errors else Loaded(found, order, [], warnings)


def _flat(column: pa.Array) -> list:
    """The values of a column of numbers, texts or flags; these ways are several times as fast as to_pylist."""
    if pa.types.is_string(column.type) or not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _lists(column: pa.Array) -> list:
    """The lists of a list column, or None where it is null."""
    if column.null_count == len(column):
        return [None] * len(column)
    cuts = column.offsets.to_numpy()
    held = _flat(column.values.slice(cuts[0], cuts[-1] - cuts[0]))
    cuts = (cuts - cuts[0]).tolist()
    if not column.null_count:
        return [held[a:b] for a, b in zip(cuts, cuts[1:])]
    return [held[a:b] if ok else None for a, b, ok in zip(cuts, cuts[1:], _flat(column.is_valid()))]


def _maps(column: pa.Array) -> list:
    """The (name, list) entries of maps that come as lists of names, each before the number of its files, or -1 for no list, and before these."""

    def entries(held: list) -> Iterator[tuple[str, list | None]]:
        at = 0
        while at < len(held):
            n = int(held[at + 1])
            yield held[at], None if n < 0 else held[at + 2 : at + 2 + n]
            at += 2 + max(n, 0)

    return [None if held is None else list(entries(held)) for held in _lists(column)]


def _files(column: pa.Array) -> list:
    """(ins, outs) from lists of files, each behind an i or an o; (None, None) where there is no list."""
    return [(None, None) if held is None else ([f[1:] for f in held if f[0] == "i"], [f[1:] for f in held if f[0] == "o"]) for held in _lists(column)]


#: The columns that the result has besides those of the specs.
ADDED = "kind string, name string, value_pos int, value string, level int, position long, stage string, rule string, detail string"
#: The columns of a spec that a loaded step keeps; rows that are left alone keep all.
KEPT = ("workflow_id", "ordinal", "tool", "command", "input", "output", "threads", "color")


def loader(columns: list[str], mode: str, most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over spec rows, in which those of a workflow stand together.

    Its rows hold ``columns`` but wildcard_files, and _n (rows that stand together), _flags, _names, _own (see _files) and _maps, as few and plain
    columns as can be, since Spark measures each column of a batch for every row that it adds. The result has ``columns`` and ADDED. kind: a step that loads, an error, a warning, or rest, a row as it came, of a workflow that is not loaded here.
    """
    ints, texts = pa.int64(), pa.string()

    def batch_of(table: pa.Table, steps: list[Step], made: list[tuple], told: list[tuple], rest: list[int]) -> pa.RecordBatch:
        """made: (at, value_pos, value, step_id, previous, next, level, position) of steps; told: (at, kind, step_id, stage, rule, detail); rest: places of rows."""
        at, value_pos, value, step_id, previous, following, level, position = zip(*made) if made else [()] * 8
        about, kind, whose, stage, rule, detail = zip(*told) if told else [()] * 6
        n, alone = len(at), len(about) + len(rest)
        name = [None if v is None else steps[a].names[0] for a, v in zip(at, value)]
        left = pa.array(rest, ints)
        whole, only = pa.array([*at, *about, *rest], ints), pa.concat_arrays([pa.nulls(n + len(about), ints), left])
        none = lambda t, size: pa.nulls(size, t)
        arrays = []
        for c in columns:
            if c == "wildcard_files":
                arrays.append(pa.array([None] * (n + len(about)) + [steps[a].files for a in rest], pa.map_(texts, pa.list_(texts))))
                continue
            old = table[c].chunk(0)
            if c == "step_id":
                arrays.append(pa.concat_arrays([pa.array([*step_id, *whose], texts), old.take(left)]))
            elif c in ("previous", "next"):
                fresh = pa.array(previous if c == "previous" else following, pa.list_(texts)).cast(old.type)
                arrays.append(pa.concat_arrays([fresh, none(old.type, len(about)), old.take(left)]))
            else:
                arrays.append(old.take(whole if c in KEPT else only))
        arrays.append(pa.array([*["step"] * n, *kind, *["rest"] * len(rest)], texts))
        for values, t in ((name, texts), (value_pos, pa.int32()), (value, texts), (level, pa.int32()), (position, ints)):
            arrays.append(pa.concat_arrays([pa.array(values, t), none(t, alone)]))
        for values in (stage, rule, detail):
            arrays.append(pa.concat_arrays([none(texts, n), pa.array(values, texts), none(texts, len(rest))]))
        return pa.RecordBatch.from_arrays(arrays, names=[*columns, *[c.split()[0] for c in ADDED.split(", ")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is there before is left out of the collector's rounds, which many small lists and tuples call for.
        gc.freeze()
        try:
            yield from loaded(batches)
        finally:
            gc.unfreeze()

    def loaded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wanted, left = [], 0, 1, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < wanted:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: table[c].chunk(0)  # noqa: E731, B023
            sizes, gaps = _flat(column("_n")), column("_names").null_count > 0
            flat = [_flat(column(c)) for c in ("ordinal", "step_id", "command", "_flags")]
            nested = [_lists(column(c)) for c in ("previous", "next", "_names")]
            steps = [Step(o, i, p, n, names, c, f, ins, outs, m) for o, i, p, n, names, c, f, (ins, outs), m in zip(flat[0], flat[1], *nested, flat[2], flat[3], _files(column("_own")), _maps(column("_maps")))]
            at = min(left, rows)
            made, told, rest, left = [], [], list(range(at)), left - at
            while at < rows:
                n = sizes[at]
                end = min(at + n, rows)
                local = steps[at].flags & LOCAL
                if local and at + n > rows:
                    break
                # A list with a null has no names.
                here = local and not (gaps and any(s.names is None for s in steps[at:end]))
                found = load_one(steps[at:end], mode, most) if here else None
                if found is None:
                    rest.extend(range(at, end))
                    left = at + n - end
                else:
                    made.extend([(at + f[0], f[1], f[2], f[3], f[4], f[5], *o) for f, o in zip(found.steps, found.order)])
                    if found.errors or found.warnings:
                        told.extend((at, "error", step_id, stage, rule, detail) for stage, step_id, rule, detail in found.errors)
                        told.extend((at, "warning", step_id, "validation", rule, detail) for step_id, rule, detail in found.warnings)
                at = end
                if len(made) + len(told) + len(rest) > 20_000:
                    yield batch_of(table, steps, made, told, rest)
                    made, told, rest = [], [], []
            if made or told or rest:
                yield batch_of(table, steps, made, told, rest)
            held, wanted = ([], 1) if at == rows else (table.slice(at).to_batches(), sizes[at])
            rows -= at
        if held:
            raise RuntimeError("rows of a workflow are apart")

    return run
