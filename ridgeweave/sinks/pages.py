"""Static pages: an index with filters, and one page for each route."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterator
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeweave.config import Settings
from ridgeweave.operators import areas, attribution
from ridgeweave.operators.samples import in_degrees, markers, simplified, steep
from ridgeweave.sinks.drawing import overview_map, profile_chart, route_map
from ridgeweave.sinks.files import dump, each_file, plain, points_of, write_collection
from ridgeweave.sinks.writer import write_files

#: Metres between the points of a line on the map of all routes, at least.
MAP_TOLERANCE_M = 25.0

HEAD = '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>body{{font:15px sans-serif;margin:1.5rem;max-width:70rem}}td,th{{padding:.2rem .7rem;text-align:left}}svg{{max-width:100%}}</style></head><body><h1>{title}</h1>'
INDEX = """
<p><label>Budget <select id="budget"><option value="">all</option></select></label> <label>Mode <select id="mode"><option value="">all</option></select></label>
<label>Sort <select id="sort"><option value="ascent_m">ascent</option><option value="gain_density_m_per_km">density</option><option value="source_confidence">confidence</option></select></label>
<label>Show <input id="most" type="number" min="1" value="{most}"></label></p><table id="routes"></table>
<script>
const routes = {routes}, steep = {steep};
const pick = (id) => document.getElementById(id);
for (const [id, key] of [["budget", "budget_km"], ["mode", "mode"]])
  for (const v of new Set(routes.map((r) => r[key]))) pick(id).add(new Option(v, v));
function draw() {{
  const kept = routes.filter((r) => (!pick("budget").value || r.budget_km == pick("budget").value) && (!pick("mode").value || r.mode === pick("mode").value));
  kept.sort((a, b) => b[pick("sort").value] - a[pick("sort").value]);
  pick("routes").replaceChildren(...kept.slice(0, +pick("most").value).map((r) => {{
    const row = document.createElement("tr"), link = document.createElement("a");
    link.href = "routes/" + r.route_id + ".html";
    link.textContent = r.display_name;
    row.insertCell().append(link);
    row.insertCell().textContent = (steep[r.route_id] || []).length + " steep";
    return row;
  }}));
}}
for (const id of ["budget", "mode", "sort", "most"]) pick(id).addEventListener("change", draw);
draw();
</script></body></html>"""


def script_json(value) -> str:
    """JSON that can stand inside a script element."""
    return json.dumps(plain(value), allow_nan=False).replace("<", "\\u003c")


def table(rows: list[dict], columns: list[str]) -> str:
    cells = lambda r: "".join(f"<td>{escape(str(r.get(c) if r.get(c) is not None else ''))}</td>" for c in columns)
    return f"<table><tr>{''.join(f'<th>{escape(c)}</th>' for c in columns)}</tr>{''.join(f'<tr>{cells(r)}</tr>' for r in rows)}</table>"


def gathered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """(route_id, name): the rows of each route, ordered, as an array."""
    rest = [c for c in df.columns if c != "route_id"]
    return df.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias(name))


FACTS = ("budget_km", "mode", "rank", "distance_m", "ascent_m", "descent_m", "gain_density_m_per_km", "source_confidence")


def page_files(r: dict) -> Iterator[tuple[str, bytes]]:
    """A route's page, and its samples as JSON."""
    r = plain(r)
    key, points = r["route_id"], r["points"] or []
    rows = lambda name: r[name] or []
    body = table([{"fact": k, "value": r[k]} for k in FACTS], ["fact", "value"]) + "".join(f"<p>{escape(w)}</p>" for w in r["warnings"])
    body += route_map([(p["lon"], p["lat"]) for p in points], rows("markers"), r["display_name"])
    body += profile_chart([p["cum_distance_km"] for p in points], [p["elevation_smooth_m"] for p in points], [p["grade_smooth_pct"] for p in points])
    body += "<h2>Steep sections</h2>" + table(rows("sections"), ["start_distance_m", "end_distance_m", "max_abs_grade_pct"])
    body += "<h2>Sources</h2>" + table(rows("sources"), ["label", "publisher", "distance_m", "share_pct", "confidence"])
    body += "<h2>Records</h2>" + table(rows("records"), ["source_key", "feature_id", "distance_m", "share_pct"])
    body += f"<p>{escape(r['elevation_note'])}</p>"
    body += f"<p>{sum(p.get('highway') == 'steps' for p in points)} samples on steps</p><script>const samples = {script_json(points)};</script></body></html>"
    yield f"routes/{key}.html", (HEAD.format(title=escape(r["display_name"])) + body).encode()
    yield f"assets/route_samples/{key}.json", dump(points).encode()


def render(routes: DataFrame, samples: DataFrame, lines: DataFrame, folder: str | Path, settings: Settings | None = None) -> None:
    """Index, pages, and the JSON they rest on.

    Pages are written by tasks, a route at a time. The index lists all routes,
    whose number the search's settings bound, with lines of few points.
    """
    get = (lambda k, d: d) if settings is None else settings.get
    out = Path(folder)
    threshold = float(get("visualization.steep_grade_threshold_pct", 12))
    named = areas.display_names(routes, samples)
    sections = gathered(steep(samples, threshold), ["start_distance_m"], "sections")
    whole = named.join(points_of(samples), "route_id", "left").join(sections, "route_id", "left").join(gathered(markers(samples, threshold), ["sample_index", "kind"], "markers"), "route_id", "left")
    for name, df, key in (("sources", attribution.source_records(attribution.path_sources(samples)), ["source_key"]), ("records", attribution.used_records(samples), ["source_key", "feature_id"])):
        whole = whole.join(gathered(df.withColumn("minus", -F.col("distance_m")), ["minus", *key], name), "route_id", "left")
    source = attribution.elevation_source(routes.sparkSession).first()
    whole = whole.withColumn("elevation_note", F.lit(f"Elevation: {source['label']}, {source['publisher']}"))
    write_files(each_file(whole, page_files), out, ("routes/*.html", "routes/*.gpx", "routes/*.geojson", "assets/route_samples/*.json"))
    write_collection(named, lines, out / "assets" / "routes.geojson")
    summaries = [plain(r) for r in named.collect()]
    (out / "assets" / "route_summary.json").write_text(dump(summaries))
    steep_of = {r["route_id"]: [plain(x) for x in r["sections"]] for r in sections.toLocalIterator()}
    drawn = {r["route_id"]: [tuple(p) for p in r["line"]] for r in lines.select("route_id", in_degrees(simplified(F.col("coords"), MAP_TOLERANCE_M)).alias("line")).orderBy("route_id").toLocalIterator()}
    index = INDEX.format(most=int(get("visualization.max_routes_shown_default", 100)), routes=script_json(summaries), steep=script_json(steep_of))
    overview = overview_map(drawn, {r["route_id"]: r["display_name"] for r in summaries})
    (out / "index.html").write_text(HEAD.format(title="Routes by ascent") + overview + index)
    downloads = (settings.outputs_dir if settings else out.parent) / "routes"
    for r in summaries:
        for name in (f"{r['route_id']}.gpx", f"{r['route_id']}.geojson"):
            if (downloads / name).exists():
                shutil.copyfile(downloads / name, out / "routes" / name)
