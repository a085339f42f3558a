"""Settings: defaults, a YAML file over them, and paths relative to the file's folder."""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass
from pathlib import Path
from typing import Any

# The defaults of every setting.
DEFAULTS: dict[str, Any] = {
    "project_root": ".",
    "data_dir": "data",
    "outputs_dir": "outputs",
    "budgets_km": [5, 10, 15, 20],
    "modes": ["loop", "point_to_point"],
    "path_processing": {"split_intersections": False, "node_precision_m": 0.01, "endpoint_snap_tolerance_m": 5.0},
    "contours": {"folderpath_patterns": ["contour", "height"], "densify_spacing_m": 100, "max_interpolation_points": 50000},
    "elevation": {"edge_sample_spacing_m": 10, "smooth_window_m": 30, "plausible_min_m": -20, "plausible_max_m": 200},
    "routing": {
        "beam_width": 400,
        "max_routes_per_budget": 100,
        "max_start_nodes": None,
        "start_node_grid_m": 1500,
        "max_start_nodes_per_grid": 4,
        "route_diversity_grid_m": 3000,
        "max_routes_per_grid": 1,
        "frontier_grid_m": 3000,
        "max_frontier_states_per_grid": 3,
        "jaccard_similarity_threshold": 0.85,
        "length_jaccard_similarity_threshold": 0.78,
        "length_containment_similarity_threshold": 0.88,
        "min_ascent_m": 30,
        "landmark_path_name_patterns": ["Summit Path", "South View Path", "Cave Path"],
    },
    "visualization": {
        "steep_grade_threshold_pct": 12,
        "sample_spacing_m": 10,
        "max_routes_shown_default": 100,
        "tile_url": "https://{s}.basemaps.cartocdn.com/light_all/{z}/{x}/{y}{r}.png",
        "tile_attribution": "&copy; OpenStreetMap contributors &copy; CARTO",
        "tile_max_zoom": 20,
    },
    "sources": {
        "data_gov": {
            "nparks_tracks": "d_306cc1018cb733346681883ee6d73054",
            "central_nature_reserve": "d_84e6db6c43ffb8b17803334ec2b5c95d",
            "park_connector_loop": "d_a69ef89737379f231d2ae93fd1c5707f",
            "national_map_line": "d_10480c0b59e65663dfae1028ff4aa8bb",
        },
        "osm": {
            "enabled": True,
            "singapore_bbox_wgs84": [103.55, 1.15, 104.12, 1.55],
            "geofabrik_url": "https://download.geofabrik.de/asia/malaysia-singapore-brunei-latest.osm.pbf",
            "local_path": None,
        },
    },
}

# The folders that every run finds.
FOLDERS = ("raw/data_gov", "raw/osm", "cache", "processed/paths", "processed/elevation", "processed/graph", "fixtures")
OUTPUTS = ("routes", "maps", "profiles", "viz/assets/route_samples", "viz/routes")


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``base`` with ``over`` on top: mappings merge, anything else replaces."""
    return {k: merge(base[k], over[k]) if k in base and k in over and isinstance(base[k], dict) and isinstance(over[k], dict) else deepcopy(over[k] if k in over else base[k]) for k in [*base, *(k for k in over if k not in base)]}


@dataclass(frozen=True)
class Settings:
    values: dict[str, Any]
    file: Path | None = None

    @property
    def root(self) -> Path:
        """The project's root; a relative one counts from the file's folder."""
        return ((self.file.parent if self.file else Path.cwd()) / self.values.get("project_root", ".")).resolve()

    def path(self, value: str | Path | None) -> Path:
        if value is None:
            raise ValueError("a path is missing")
        return self.root / value

    @property
    def data_dir(self) -> Path:
        return self.path(self.values["data_dir"])

    @property
    def outputs_dir(self) -> Path:
        return self.path(self.values["outputs_dir"])

    def get(self, dotted: str, default: Any = None) -> Any:
        """A setting by its dotted name; a stored null is returned as it is."""
        found: Any = self.values
        for part in dotted.split("."):
            if not (isinstance(found, dict) and part in found):
                return default
            found = found[part]
        return found

    def make_folders(self) -> None:
        for base, names in ((self.data_dir, FOLDERS), (self.outputs_dir, OUTPUTS)):
            for name in names:
                (base / name).mkdir(parents=True, exist_ok=True)


def load(path: str | Path | None = None) -> Settings:
    """Defaults, with the settings of a YAML file over them."""
    if path is None:
        return Settings(deepcopy(DEFAULTS))
    import yaml

    file = Path(path).resolve()
    if not file.exists():
        raise FileNotFoundError(f"no such settings file: {file}")
    return Settings(merge(DEFAULTS, yaml.safe_load(file.read_text()) or {}), file)
