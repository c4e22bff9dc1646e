"""Mesh and polygon file formats: bytes to arrays and back, in plain Python and numpy.

A mesh is (vertices [n, 3], faces [m, 3]); readers give a list of (name, vertices,
faces).  A polygon file gives rings, each an array of points.
"""

from __future__ import annotations

import io
import json
import math
import re
import struct
import xml.etree.ElementTree as ET
import zipfile

import numpy as np

Mesh = tuple[str, np.ndarray, np.ndarray]
#: File extension to format name.
EXTENSIONS = {"stl": "STL", "obj": "OBJ", "off": "OFF", "ply": "PLY", "3mf": "3MF", "model": "MODEL", "amf": "AMF", "json": "JSON", "csv": "CSV", "svg": "SVG", "dxf": "DXF"}
#: Names of length units and their sizes in millimetres.
UNITS = {"micron": 0.001, "micrometer": 0.001, "millimeter": 1.0, "mm": 1.0, "centimeter": 10.0, "cm": 10.0, "inch": 25.4, "in": 25.4, "foot": 304.8, "ft": 304.8, "meter": 1000.0, "m": 1000.0}


def format_of(path: str) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())


def extension_of(kind: str) -> str | None:
    """File extension of a format."""
    return next((e for e, k in EXTENSIONS.items() if k == kind), None)


def units_of(text: str) -> float | None:
    """Millimetres of the first unit named in comments, if one is."""
    for word in re.findall(r"[a-z]+", text.lower()):
        size = UNITS.get(word) or UNITS.get(word.rstrip("s"))
        if size and len(word) > 1:
            return size
    return None


def _soup(name: str, corners: np.ndarray) -> Mesh:
    """Mesh of triangles given by their corners; equal corners are one vertex."""
    vertices, at = np.unique(corners.reshape(-1, 3), axis=0, return_inverse=True)
    return name, vertices, at.reshape(-1, 3)


def read_stl(data: bytes) -> list[Mesh]:
    """Binary if the length fits the count, else ASCII with any number of solids."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        table = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("c", "<u2")]), offset=84)
        return [_soup(data[:80].split(b"\0")[0].decode("ascii", "replace").strip(), table["p"].astype(float))]
    out, name, corners = [], "", []
    for line in data.decode("utf-8", "replace").splitlines():
        words = line.split()
        if not words:
            continue
        head = words[0].lower()
        if head == "solid":
            name, corners = " ".join(words[1:]), []
        elif head == "vertex":
            corners.append([float(w) for w in words[1:4]])
        elif head == "endsolid":
            if corners:
                out.append(_soup(name, np.array(corners)))
            corners = []
    if corners:
        out.append(_soup(name, np.array(corners)))
    return out


def write_stl(mesh: Mesh, binary: bool = True) -> bytes:
    name, vertices, faces = mesh
    p = vertices[faces]
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    n = n / np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
    if binary:
        table = np.zeros(len(faces), np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("c", "<u2")]))
        table["n"], table["p"] = n, p
        return name.encode()[:80].ljust(80, b"\0") + struct.pack("<I", len(faces)) + table.tobytes()
    lines = [f"solid {name}"]
    for normal, triangle in zip(n, p, strict=True):
        lines += ["facet normal {:.9g} {:.9g} {:.9g}".format(*normal), "outer loop", *["vertex {:.17g} {:.17g} {:.17g}".format(*v) for v in triangle], "endloop", "endfacet"]
    return ("\n".join([*lines, f"endsolid {name}"]) + "\n").encode()


def _fan(polygon: list[int]) -> list[tuple[int, int, int]]:
    return [(polygon[0], polygon[i], polygon[i + 1]) for i in range(1, len(polygon) - 1)]


def read_obj(data: bytes) -> list[Mesh]:
    """Groups and objects are meshes; polygons are cut into fans; negative numbers count from the end."""
    vertices, groups, name = [], {}, ""
    for line in data.decode("utf-8", "replace").replace("\\\n", " ").splitlines():
        words = line.split("#")[0].split()
        if not words:
            continue
        if words[0] == "v":
            vertices.append([float(w) for w in words[1:4]])
        elif words[0] in ("g", "o"):
            name = " ".join(words[1:])
        elif words[0] == "f":
            numbers = [int(w.split("/")[0]) for w in words[1:]]
            groups.setdefault(name, []).extend(_fan([n - 1 if n > 0 else len(vertices) + n for n in numbers]))
    table = np.array(vertices, dtype=float).reshape(-1, 3)
    return [_compact(name, table, np.array(faces)) for name, faces in groups.items()]


def _compact(name: str, vertices: np.ndarray, faces: np.ndarray) -> Mesh:
    used, at = np.unique(faces, return_inverse=True)
    return name, vertices[used], at.reshape(-1, 3)


def write_obj(mesh: Mesh) -> bytes:
    name, vertices, faces = mesh
    lines = [f"o {name}", *["v {:.17g} {:.17g} {:.17g}".format(*v) for v in vertices], *["f {} {} {}".format(*(f + 1)) for f in faces]]
    return ("\n".join(lines) + "\n").encode()


def read_off(data: bytes) -> list[Mesh]:
    """Counts, vertices and polygon faces; extra numbers of a vertex or face are passed over."""
    rows = [r.split() for line in data.decode("utf-8", "replace").splitlines() if (r := line.split("#")[0].strip())]
    head = rows.pop(0)
    if not head[0].upper().endswith("OFF"):
        raise ValueError("no OFF header")
    counts = head[1:] if len(head) > 3 else rows.pop(0)
    n, m = int(counts[0]), int(counts[1])
    vertices = np.array([[float(w) for w in r[:3]] for r in rows[:n]])
    faces = [t for r in rows[n : n + m] for t in _fan([int(w) for w in r[1 : 1 + int(r[0])]])]
    return [("", vertices, np.array(faces).reshape(-1, 3))]


def write_off(mesh: Mesh) -> bytes:
    _, vertices, faces = mesh
    lines = ["OFF", f"{len(vertices)} {len(faces)} 0", *["{:.17g} {:.17g} {:.17g}".format(*v) for v in vertices], *["3 {} {} {}".format(*f) for f in faces]]
    return ("\n".join(lines) + "\n").encode()


#: PLY type names and their codes.
PLY_TYPES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


def read_ply(data: bytes) -> list[Mesh]:
    """ASCII and both binary orders; elements in the header's layout."""
    end = data.index(b"end_header")
    body = data[data.index(b"\n", end) + 1 :]
    kind, elements = "ascii", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append((words[-1], words[1:-1]))
    words, at, order = iter(body.split()) if kind == "ascii" else None, 0, "<" if "little" in kind else ">"

    def take(name: str):
        nonlocal at
        if words is not None:
            return float(next(words))
        code = order + PLY_TYPES[name]
        value = struct.unpack_from(code, body, at)[0]
        at += struct.calcsize(code)
        return value

    vertices, faces = [], []
    for element, count, properties in elements:
        for _ in range(count):
            row = {}
            for name, types in properties:
                row[name] = [take(types[2]) for _ in range(int(take(types[1])))] if types[0] == "list" else take(types[0])
            if element == "vertex":
                vertices.append([row["x"], row["y"], row["z"]])
            elif element == "face":
                faces += _fan([int(v) for v in next(v for v in row.values() if isinstance(v, list))])
    return [("", np.array(vertices, dtype=float).reshape(-1, 3), np.array(faces, dtype=int).reshape(-1, 3))]


def write_ply(mesh: Mesh, binary: bool = False) -> bytes:
    _, vertices, faces = mesh
    kind = "binary_little_endian" if binary else "ascii"
    head = f"ply\nformat {kind} 1.0\nelement vertex {len(vertices)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    if binary:
        table = np.zeros(len(faces), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
        table["n"], table["v"] = 3, faces
        return head.encode() + vertices.astype("<f8").tobytes() + table.tobytes()
    return (head + "".join("{:.17g} {:.17g} {:.17g}\n".format(*v) for v in vertices) + "".join("3 {} {} {}\n".format(*f) for f in faces)).encode()


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def read_model(data: bytes) -> list[Mesh]:
    """The XML model of a 3MF package: mesh objects, placed by the build's items."""
    root, objects = ET.fromstring(data), {}
    for node in root.iter():
        if _tag(node) == "object":
            v = np.array([[float(p.get(a)) for a in "xyz"] for p in node.iter() if _tag(p) == "vertex"]).reshape(-1, 3)
            f = np.array([[int(p.get(a)) for a in ("v1", "v2", "v3")] for p in node.iter() if _tag(p) == "triangle"], dtype=int).reshape(-1, 3)
            parts = [(p.get("objectid"), p.get("transform")) for p in node.iter() if _tag(p) == "component"]
            objects[node.get("id")] = (node.get("name") or "", v, f, parts)

    def placed(key: str, transform: str | None) -> list[Mesh]:
        name, v, f, parts = objects[key]
        out = [(name, v, f)] if len(f) else []
        for other, own in parts:
            out += placed(other, own)
        if transform:
            m = np.array([float(w) for w in transform.split()]).reshape(4, 3)
            out = [(a, b @ m[:3] + m[3], c) for a, b, c in out]
        return out

    items = [(n.get("objectid"), n.get("transform")) for n in root.iter() if _tag(n) == "item"] or [(k, None) for k in objects]
    return [mesh for key, transform in items for mesh in placed(key, transform)]


def read_3mf(data: bytes) -> list[Mesh]:
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        return [mesh for name in package.namelist() if name.lower().endswith(".model") for mesh in read_model(package.read(name))]


def write_model(meshes: list[Mesh]) -> bytes:
    objects = []
    for i, (name, vertices, faces) in enumerate(meshes, 1):
        v = "".join('<vertex x="{:.17g}" y="{:.17g}" z="{:.17g}"/>'.format(*p) for p in vertices)
        f = "".join('<triangle v1="{}" v2="{}" v3="{}"/>'.format(*t) for t in faces)
        objects.append(f'<object id="{i}" name="{name}" type="model"><mesh><vertices>{v}</vertices><triangles>{f}</triangles></mesh></object>')
    items = "".join(f'<item objectid="{i}"/>' for i in range(1, len(meshes) + 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><model unit="millimeter" xmlns="http://schemas.microsoft.com/3dmanufacturing/core/2015/02"><resources>{"".join(objects)}</resources><build>{items}</build></model>'.encode()


def write_3mf(meshes: list[Mesh]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>')
        package.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Target="/3D/3dmodel.model" Id="r0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"/></Relationships>')
        package.writestr("3D/3dmodel.model", write_model(meshes))
    return out.getvalue()


def read_amf(data: bytes) -> list[Mesh]:
    """Objects with their volumes, plain or zipped; constellations shift copies."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as package:
            data = package.read(package.namelist()[0])
    root, objects = ET.fromstring(data), {}
    for node in root.findall("object"):
        v = np.array([[float(c.find(a).text) for a in "xyz"] for c in node.iter("coordinates")]).reshape(-1, 3)
        f = np.array([[int(t.find(a).text) for a in ("v1", "v2", "v3")] for t in node.iter("triangle")], dtype=int).reshape(-1, 3)
        name = next((m.text for m in node.findall("metadata") if m.get("type") == "name"), "")
        objects[node.get("id")] = (name or "", v, f)
    copies = [(i.get("objectid"), [float(i.findtext(f"delta{a}", "0")) for a in "xyz"]) for c in root.findall("constellation") for i in c.findall("instance")]
    return [(objects[k][0], objects[k][1] + np.array(shift), objects[k][2]) for k, shift in copies] or list(objects.values())


def write_amf(meshes: list[Mesh]) -> bytes:
    out = []
    for i, (name, vertices, faces) in enumerate(meshes):
        v = "".join("<vertex><coordinates><x>{:.17g}</x><y>{:.17g}</y><z>{:.17g}</z></coordinates></vertex>".format(*p) for p in vertices)
        f = "".join("<triangle><v1>{}</v1><v2>{}</v2><v3>{}</v3></triangle>".format(*t) for t in faces)
        out.append(f'<object id="{i}"><metadata type="name">{name}</metadata><mesh><vertices>{v}</vertices><volume>{f}</volume></mesh></object>')
    return f'<?xml version="1.0"?><amf unit="millimeter">{"".join(out)}</amf>'.encode()


def read_json_mesh(data: bytes) -> list[Mesh]:
    """Solids with flat coordinate and index lists, at any depth of a document."""
    out = []

    def walk(node) -> None:
        if isinstance(node, dict):
            if "VertexCoords" in node and "FaceIndices" in node:
                out.append((node.get("Name") or "", np.array(node["VertexCoords"], float).reshape(-1, 3), np.array(node["FaceIndices"], int).reshape(-1, 3)))
            for value in node.values():
                walk(value)
        elif isinstance(node, list):
            for value in node:
                if isinstance(value, (dict, list)):
                    walk(value)

    walk(json.loads(data))
    return out


def write_json_mesh(mesh: Mesh) -> bytes:
    name, vertices, faces = mesh
    return json.dumps({"Name": name, "NumberOfVertices": len(vertices), "NumberOfFaces": len(faces), "VertexCoords": vertices.ravel().tolist(), "FaceIndices": faces.ravel().tolist()}).encode()


READERS = {"STL": read_stl, "OBJ": read_obj, "OFF": read_off, "PLY": read_ply, "3MF": read_3mf, "MODEL": read_model, "AMF": read_amf, "JSON": read_json_mesh}
WRITERS = {"STL": write_stl, "OBJ": write_obj, "OFF": write_off, "PLY": write_ply, "3MF": lambda m: write_3mf([m]), "MODEL": lambda m: write_model([m]), "AMF": lambda m: write_amf([m]), "JSON": write_json_mesh}


def read_csv_ring(data: bytes) -> list[np.ndarray]:
    """x and y per line, parted by comma, space or tab; lines with fewer fields are passed over."""
    rows = [re.split(r"[,\s]+", line.strip()) for line in data.decode("utf-8", "replace").splitlines()]
    return [np.array([[float(r[0]), float(r[1])] for r in rows if len(r) >= 2 and r[0]])]


def read_json_rings(data: bytes) -> list[np.ndarray]:
    """Flat coordinates of a polygon and of those nested in it, outer first."""
    out = []

    def walk(node: dict) -> None:
        out.append(np.array(node["Coordinates"], float).reshape(-1, 2))
        for inner in node.get("Inners") or []:
            walk(inner)

    document = json.loads(data)
    for node in document if isinstance(document, list) else [document]:
        walk(node)
    return out


def curve(controls: list[np.ndarray], steps: int = 24) -> list[np.ndarray]:
    """Points of a Bézier curve of any degree, without the first."""
    out = []
    for t in np.arange(1, steps + 1) / steps:
        level = controls
        while len(level) > 1:
            level = [a + (b - a) * t for a, b in zip(level[:-1], level[1:], strict=True)]
        out.append(level[0])
    return out


def arc(start: np.ndarray, end: np.ndarray, rx: float, ry: float, tilt: float, large: bool, sweep: bool, steps: int = 32) -> list[np.ndarray]:
    """Points of an elliptical arc between two points, without the first."""
    if rx == 0 or ry == 0 or np.allclose(start, end):
        return [end]
    c, s = math.cos(math.radians(tilt)), math.sin(math.radians(tilt))
    turn = np.array([[c, s], [-s, c]])
    half = turn @ (start - end) / 2 / np.array([rx, ry])
    size = float(half @ half)
    if size > 1:
        rx, ry, half, size = rx * math.sqrt(size), ry * math.sqrt(size), half / math.sqrt(size), 1.0
    side = math.sqrt(max(0.0, 1 / size - 1)) * (-1 if large == sweep else 1)
    middle = side * np.array([half[1], -half[0]])
    a, b = half - middle, -half - middle
    first = math.atan2(a[1], a[0])
    way = (math.atan2(b[1], b[0]) - first) % (2 * math.pi)
    way = way if sweep else way - 2 * math.pi
    centre = turn.T @ (middle * np.array([rx, ry])) + (start + end) / 2
    return [centre + turn.T @ (np.array([rx * math.cos(first + way * t), ry * math.sin(first + way * t)])) for t in np.arange(1, steps + 1) / steps]


def path_rings(text: str) -> list[np.ndarray]:
    """Rings of the SVG path language."""
    tokens = re.findall(r"[MmLlHhVvCcSsQqTtAaZz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text)
    rings: list[list[np.ndarray]] = []
    at, first, last, command, i = np.zeros(2), np.zeros(2), None, "", 0

    def numbers(n: int) -> list[float]:
        nonlocal i
        i += n
        return [float(t) for t in tokens[i - n : i]]

    def point(relative: bool) -> np.ndarray:
        return np.array(numbers(2)) + (at if relative else 0)

    while i < len(tokens):
        if tokens[i].isalpha():
            command = tokens[i]
            i += 1
            if command in "Zz":
                at, last = first, None
                continue
        kind, relative, control = command.upper(), command.islower(), None
        if kind == "M":
            at = first = point(relative)
            rings.append([at])
            command = "l" if relative else "L"
        else:
            if kind == "H":
                new = [np.array([numbers(1)[0] + (at[0] if relative else 0), at[1]])]
            elif kind == "V":
                new = [np.array([at[0], numbers(1)[0] + (at[1] if relative else 0)])]
            elif kind == "L":
                new = [point(relative)]
            elif kind in "CSQT":
                mirrored = 2 * at - last if last is not None else at
                controls = [at, mirrored] if kind in "ST" else [at]
                controls += [point(relative) for _ in range({"C": 3, "S": 2, "Q": 2, "T": 1}[kind])]
                new, control = curve(controls), controls[-2]
            else:
                rx, ry, tilt, large, sweep = numbers(5)
                new = arc(at, point(relative), rx, ry, tilt, bool(large), bool(sweep))
            rings[-1] += new
            at = new[-1]
        last = control
    return [np.array(r[:-1] if len(r) > 1 and np.allclose(r[0], r[-1]) else r) for r in rings]


def read_svg(data: bytes, flip: bool = False) -> list[np.ndarray]:
    """Rings of polygons, polylines, rectangles, circles, ellipses and paths, with their transforms."""
    out = []

    def matrix(text: str) -> np.ndarray:
        m = np.eye(3)
        for name, values in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
            v = [float(w) for w in re.split(r"[,\s]+", values.strip())]
            step = np.eye(3)
            if name == "matrix":
                step[:2] = np.array(v).reshape(3, 2).T
            elif name == "translate":
                step[:2, 2] = v[0], v[1] if len(v) > 1 else 0
            elif name == "scale":
                step[0, 0], step[1, 1] = v[0], v[-1]
            elif name == "rotate":
                c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
                step[:2, :2] = [[c, -s], [s, c]]
                if len(v) == 3:
                    step[:2, 2] = np.array(v[1:]) - step[:2, :2] @ np.array(v[1:])
            m = m @ step
        return m

    def walk(node, outer: np.ndarray) -> None:
        own = outer @ matrix(node.get("transform"))
        kind, rings = _tag(node), []

        def number(name: str) -> float:
            return float(re.match(r"[-+.\deE]+", node.get(name, "0"))[0])

        if kind in ("polygon", "polyline"):
            rings = [np.array([float(w) for w in re.split(r"[,\s]+", node.get("points", "").strip())]).reshape(-1, 2)]
        elif kind == "rect":
            x, y, w, h = (number(n) for n in ("x", "y", "width", "height"))
            rings = [np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]])]
        elif kind in ("circle", "ellipse"):
            rx, ry = (number("r"), number("r")) if kind == "circle" else (number("rx"), number("ry"))
            t = np.arange(64) * math.pi / 32
            rings = [np.stack([number("cx") + rx * np.cos(t), number("cy") + ry * np.sin(t)], axis=1)]
        elif kind == "path":
            rings = path_rings(node.get("d", ""))
        out.extend((np.hstack([r, np.ones((len(r), 1))]) @ own.T)[:, :2] * np.array([1, -1 if flip else 1]) for r in rings)
        for child in node:
            walk(child, own)

    walk(ET.fromstring(data), np.eye(3))
    return out


def write_svg(rings: list[np.ndarray]) -> bytes:
    low, high = np.vstack(rings).min(axis=0), np.vstack(rings).max(axis=0)
    body = "".join('<polygon points="{}"/>'.format(" ".join(f"{x:.17g},{y:.17g}" for x, y in r)) for r in rings)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{low[0]:g} {low[1]:g} {high[0] - low[0]:g} {high[1] - low[1]:g}">{body}</svg>'.encode()


def bulge_points(a: np.ndarray, b: np.ndarray, bulge: float, steps: int = 16) -> list[np.ndarray]:
    """Points of the arc from ``a`` to ``b`` whose bulge is the tangent of a quarter of its angle, without the first."""
    if bulge == 0:
        return [b]
    angle = 4 * math.atan(bulge)
    chord = b - a
    centre = (a + b) / 2 + np.array([-chord[1], chord[0]]) * (1 - bulge * bulge) / (4 * bulge)
    start = a - centre
    out = []
    for t in np.arange(1, steps + 1) / steps:
        c, s = math.cos(angle * t), math.sin(angle * t)
        out.append(centre + np.array([c * start[0] - s * start[1], s * start[0] + c * start[1]]))
    return out


def read_dxf(data: bytes) -> list[np.ndarray]:
    """Rings of light polylines (with bulges), lines, circles and arcs."""
    lines = data.decode("utf-8", "replace").splitlines()
    pairs = [(int(a), b.strip()) for a, b in zip(lines[::2], lines[1::2], strict=False)]
    out, kind, fields = [], "", []

    def close() -> None:
        values: dict[int, list[float]] = {}
        for code, text in fields:
            if code in (10, 20, 11, 21, 40, 50, 51):
                values.setdefault(code, []).append(float(text))
        if kind == "LWPOLYLINE":
            spots: list[list[float]] = []
            for code, text in fields:
                if code == 10:
                    spots.append([float(text), 0.0, 0.0])
                elif code in (20, 42) and spots:
                    spots[-1][1 if code == 20 else 2] = float(text)
            ring = [np.array(spots[0][:2])]
            for p, q in zip(spots, [*spots[1:], spots[0]], strict=True):
                ring += bulge_points(np.array(p[:2]), np.array(q[:2]), p[2])
            out.append(np.array(ring[:-1]))
        elif kind == "LINE":
            out.append(np.array([[values[10][0], values[20][0]], [values[11][0], values[21][0]]]))
        elif kind in ("CIRCLE", "ARC"):
            a, b = (math.radians(values.get(c, [d])[0]) for c, d in ((50, 0), (51, 360)))
            t = a + np.arange(64) / (64 if kind == "CIRCLE" else 63) * ((b - a) % (2 * math.pi) or 2 * math.pi)
            out.append(np.stack([values[10][0] + values[40][0] * np.cos(t), values[20][0] + values[40][0] * np.sin(t)], axis=1))

    for code, text in pairs:
        if code == 0:
            close()
            kind, fields = text, []
        else:
            fields.append((code, text))
    close()
    return out


def write_dxf(rings: list[np.ndarray]) -> bytes:
    rows = ["0", "SECTION", "2", "ENTITIES"]
    for ring in rings:
        rows += ["0", "LWPOLYLINE", "90", str(len(ring)), "70", "1"]
        for x, y in ring:
            rows += ["10", f"{x:.17g}", "20", f"{y:.17g}"]
    return ("\n".join([*rows, "0", "ENDSEC", "0", "EOF"]) + "\n").encode()


def write_csv_ring(rings: list[np.ndarray]) -> bytes:
    """x,y per line; the format has one ring a file."""
    if len(rings) != 1:
        raise ValueError("a table of points holds one ring")
    return "".join("{:.17g},{:.17g}\n".format(*p) for p in rings[0]).encode()


def write_json_rings(rings: list[np.ndarray]) -> bytes:
    """One polygon: the first ring, then its inner ones."""
    def node(i: int, ring: np.ndarray) -> dict:
        return {"Index": i, "Centroid": dict(zip("XY", ring.mean(axis=0).tolist(), strict=True)), "Coordinates": ring.ravel().tolist()}

    whole = node(0, rings[0])
    if len(rings) > 1:
        whole["Inners"] = [node(i, r) for i, r in enumerate(rings[1:], 1)]
    return json.dumps(whole).encode()


RING_READERS = {"CSV": read_csv_ring, "JSON": read_json_rings, "SVG": read_svg, "DXF": read_dxf}
RING_WRITERS = {"CSV": write_csv_ring, "JSON": write_json_rings, "SVG": write_svg, "DXF": write_dxf}
