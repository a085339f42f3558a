"""Command line: fetch, inspect, build-paths, build-elevation, build-graph, search, visualize, serve, qa, all."""

from __future__ import annotations

import argparse
import functools
import http.server
import sys
from pathlib import Path

from pyspark.sql import functions as F

from ridgeweave import config
from ridgeweave.operators import elevation, graph, noding, paths, qa, samples, search
from ridgeweave.session import get_session
from ridgeweave.sinks import files, pages
from ridgeweave.sources import fetch as downloads
from ridgeweave.sources.geojson import read_vector
from ridgeweave.sources.layers import load_paths


class Run:
    """The commands over one settings file; every stage reads what the one before has written."""

    def __init__(self, file: str | None):
        self.settings = config.load(file)
        self.settings.make_folders()
        self.processed = self.settings.data_dir / "processed"

    @functools.cached_property
    def spark(self):
        return get_session()

    def table(self, name: str):
        return self.spark.read.parquet(str(self.processed / name))

    def save(self, df, name: str):
        df.write.mode("overwrite").parquet(str(self.processed / name))
        return self.table(name)

    def contours(self):
        name = "national_map_line"
        found = downloads.cached(self.settings, self.settings.data_dir / "raw" / "data_gov", name, str(self.settings.get(f"sources.data_gov.{name}", "")))
        if found is None:
            raise FileNotFoundError("no contour layer; fetch it first")
        return read_vector(self.spark, found["path"])

    def fetch(self) -> int:
        for r in downloads.fetch_layers(self.settings):
            print(f"{r['name']}: {r['path']}")
        print(f"ways: {downloads.fetch_osm(self.settings)}")
        return 0

    def inspect(self) -> int:
        for r in elevation.folder_paths(self.contours()).toLocalIterator():
            print(r[0])
        return 0

    def build_paths(self) -> int:
        s = self.settings.get
        p = self.save(load_paths(self.spark, self.settings), "paths/paths.parquet")
        if s("path_processing.split_intersections", False):
            p = noding.node_lines(p)
        nodes, edges = paths.edges_and_nodes(p, s("path_processing.node_precision_m", 0.01), s("path_processing.endpoint_snap_tolerance_m", 5.0))
        print(f"{self.save(nodes, 'paths/nodes.parquet').count()} nodes, {self.save(edges, 'paths/edges.parquet').count()} edges")
        return 0

    def build_elevation(self) -> int:
        s = self.settings.get
        lines = elevation.contour_lines(self.contours(), s("contours.folderpath_patterns", []))
        lines = self.save(lines.withColumn("coords", paths.projected(F.col("coords"))), "elevation/contours.parquet")
        points = self.save(elevation.contour_points(lines, s("contours.densify_spacing_m", 100), s("contours.max_interpolation_points")), "elevation/points.parquet")
        triangles, samples_of = elevation.Surface.of(points.toPandas()).tables(self.spark)
        edges = elevation.enrich_edges(self.table("paths/edges.parquet"), self.save(triangles, "elevation/triangles.parquet"), self.save(samples_of, "elevation/samples.parquet"), s("elevation.edge_sample_spacing_m", 10), s("elevation.smooth_window_m", 30))
        print(f"{self.save(edges, 'elevation/edges.parquet').count()} edges with profiles")
        return 0

    def build_graph(self) -> int:
        edges = self.table("elevation/edges.parquet" if (self.processed / "elevation/edges.parquet").exists() else "paths/edges.parquet")
        print(f"{self.save(graph.directed_edges(edges), 'graph/edges.parquet').count()} directed edges")
        self.save(self.table("paths/nodes.parquet"), "graph/nodes.parquet")
        return 0

    def search(self) -> int:
        r = self.settings.values["routing"]
        how = search.Search(
            r["beam_width"], r["max_routes_per_budget"], r["max_start_nodes"], r["start_node_grid_m"], r["max_start_nodes_per_grid"], r["route_diversity_grid_m"], r["max_routes_per_grid"], r["frontier_grid_m"],
            r["max_frontier_states_per_grid"], r["jaccard_similarity_threshold"], r["length_jaccard_similarity_threshold"], r["length_containment_similarity_threshold"], r["landmark_path_name_patterns"], r["min_ascent_m"],
        )
        edges, out = self.table("graph/edges.parquet"), self.settings.outputs_dir / "routes"
        found = self.save(search.search_routes(edges, self.table("graph/nodes.parquet"), self.settings.get("budgets_km"), self.settings.get("modes"), how), "graph/routes.parquet")
        lines = samples.route_lines(found, edges)
        named = samples.with_gap_warnings(found, lines).orderBy(F.desc("ascent_m"), F.desc("gain_density_m_per_km"), F.desc("source_confidence"), "route_id")
        print(f"{files.write_routes(found, samples.route_samples(found, edges), lines, out)} routes")
        files.write_routes_json(named, out / "routes.json")
        return 0

    def routes(self):
        return files.read_routes_json(self.spark, str(self.settings.outputs_dir / "routes" / "routes.json"))

    def visualize(self) -> int:
        edges, found = self.table("graph/edges.parquet"), self.routes()
        pages.render(found, samples.route_samples(found, edges), samples.route_lines(found, edges), self.settings.outputs_dir / "viz", self.settings)
        return 0

    def qa(self) -> int:
        edges, found = self.table("graph/edges.parquet"), self.routes()
        s = self.settings.get
        rows = qa.diagnostics(found, edges, samples.route_lines(found, edges), samples.route_samples(found, edges), self.settings.outputs_dir, s("elevation.plausible_min_m", -20), s("elevation.plausible_max_m", 200)).collect()
        for r in rows:
            print(f"{'ok' if r['ok'] else 'FAILED'}: {r['name']} ({r['message']})")
        return 0 if all(r["ok"] for r in rows) else 1

    def serve(self, port: int = 8000) -> int:
        handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(self.settings.outputs_dir / "viz"))
        http.server.ThreadingHTTPServer(("127.0.0.1", port), handler).serve_forever()
        return 0

    def all(self) -> int:
        steps = (self.fetch, self.build_paths, self.build_elevation, self.build_graph, self.search, self.visualize)
        return next((code for step in steps if (code := step())), 0)


COMMANDS = ("fetch", "inspect", "build-paths", "build-elevation", "build-graph", "search", "visualize", "serve", "qa", "all")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ridgeweave", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--config", help="YAML file of settings")
    given = parser.parse_args(argv)
    if given.config and not Path(given.config).exists():
        parser.error(f"no such file: {given.config}")
    return getattr(Run(given.config), given.command.replace("-", "_"))()


if __name__ == "__main__":
    sys.exit(main())
