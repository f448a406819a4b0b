"""The logical model: one normalised set of tables per collection of datasets, every table with dataset_id.

``ord`` columns hold the position of a record in its source list; they decide what "first" means.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

from .storage import stored


@dataclass(frozen=True)
class Tolerances:
    point: float = 1e-6
    volume: float = 1e-9
    length: float = 1e-3
    thickness: float = 1e-3


@dataclass(frozen=True)
class Topology:
    """point(id, ord, x, y, z), curve(id, ord, n_vertices), curve_vertex(curve_id, curve_ord, pos, point_id),
    surface(id, ord), ring_member(surface_id, surface_ord, ring_idx, member_idx, curve_id, orientation),
    solid(id, ord, volume, theme, parcel_type, parent_id, servient_id, burdened_id, host_id, level: levels joined by ``|``),
    solid_face(solid_id, solid_ord, face_idx, face_id), shell_face(…, shell_idx, shell_type, face_idx, face_id, orientation),
    observation_curve(ref, source)."""

    point: DataFrame
    curve: DataFrame
    curve_vertex: DataFrame
    surface: DataFrame
    ring_member: DataFrame
    solid: DataFrame
    solid_face: DataFrame
    shell_face: DataFrame
    observation_curve: DataFrame

    def dealt(self, df: DataFrame, join: str = "merge") -> DataFrame:
        """df, read from a file, as these tables are dealt out to tasks: no matter how, unless they say otherwise (then joined by a hint)."""
        return df

    def kept(self) -> Topology:
        """The same tables, each written to the shared folder when it is first used, so that plans over them stay small and read it instead of making it again."""
        return _Kept(**{f.name: getattr(self, f.name) for f in fields(self)})

    def mapped(self, change) -> Topology:
        """The same tables, each changed by change(name, table)."""
        return replace(self, **{f.name: change(f.name, getattr(self, f.name)) for f in fields(self)})


class _Kept(Topology):
    def __getattribute__(self, name: str):
        value = super().__getattribute__(name)
        if isinstance(value, DataFrame) and not hasattr(value, "_stored_at"):
            value = stored(value)
            object.__setattr__(self, name, value)
        return value
