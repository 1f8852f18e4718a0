"""Building files of any size, for tests and for trying the ingest at scale."""

from __future__ import annotations

from collections.abc import Iterator

# Sizes in metres: storey height, room width and depth, distance of blocks.
HEIGHT, WIDTH, DEPTH, APART = 3.5, 6.0, 5.0, 80.0


class _Ids:
    def __init__(self):
        self.last = 0

    def __call__(self) -> int:
        self.last += 1
        return self.last


def lines(blocks: int = 5, floors: int = 8, rooms: int = 12) -> Iterator[str]:
    """Blocks of floors of rooms. Every room has a wall, a flow segment and a terminal with properties; every floor has a beam."""
    new = _Ids()
    yield "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_NAME('generated','',(''),(''),'','','');\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;"

    def placed(parent: int | None, x: float, y: float, z: float) -> tuple[int, list[str]]:
        point, axis, place = new(), new(), new()
        up = f"#{parent}" if parent else "$"
        return place, [f"#{point}=IFCCARTESIANPOINT(({x:.3f},{y:.3f},{z:.3f}));", f"#{axis}=IFCAXIS2PLACEMENT3D(#{point},$,$);", f"#{place}=IFCLOCALPLACEMENT({up},#{axis});"]

    def listed(ids: list[int]) -> str:
        return ",".join(f"#{i}" for i in ids)

    project, site = new(), new()
    yield f"#{project}=IFCPROJECT('p',$,'Campus',$,$,$,$,$,$);"
    ground, text = placed(None, 0, 0, 0)
    yield from text
    yield f"#{site}=IFCSITE('s',$,'Site',$,$,#{ground},$,$,.ELEMENT.,$,$,$,$,$);"
    yield f"#{new()}=IFCRELAGGREGATES('r',$,$,$,#{project},(#{site}));"
    buildings = []
    for b in range(blocks):
        at, text = placed(ground, b * APART, 0, 0)
        yield from text
        buildings.append(building := new())
        yield f"#{building}=IFCBUILDING('b',$,'Block {b}',$,$,#{at},$,$,.ELEMENT.,$,$,$);"
        storeys = []
        for f in range(floors):
            level, text = placed(at, 0, 0, f * HEIGHT)
            yield from text
            storeys.append(storey := new())
            yield f"#{storey}=IFCBUILDINGSTOREY('f',$,'Block {b} floor {f}',$,$,#{level},$,$,.ELEMENT.,{f * HEIGHT:.2f});"
            spaces, inside = [], []
            for r in range(rooms):
                spot, text = placed(level, r % 6 * WIDTH, r // 6 * DEPTH, 0)
                yield from text
                space, wall, duct, terminal = new(), new(), new(), new()
                spaces.append(space)
                inside += [wall, duct, terminal]
                yield f"#{space}=IFCSPACE('e',$,'Room {b}.{f}.{r}',$,$,#{spot},$,$,.ELEMENT.,.INTERNAL.,$);"
                yield f"#{wall}=IFCWALL('w',$,'Wall',$,$,#{spot},$,$);"
                yield f"#{duct}=IFCFLOWSEGMENT('d',$,'Duct',$,$,#{spot},$,$);"
                yield f"#{terminal}=IFCFLOWTERMINAL('t',$,'Terminal',$,$,#{spot},$,$);"
                maker, kind, group = new(), new(), new()
                yield f"#{maker}=IFCPROPERTYSINGLEVALUE('Manufacturer',$,IFCLABEL('Maker {r % 3}'),$);"
                yield f"#{kind}=IFCPROPERTYSINGLEVALUE('Type Name',$,IFCLABEL('Type {r % 5}'),$);"
                yield f"#{group}=IFCPROPERTYSET('q',$,'Data',$,(#{maker},#{kind}));"
                yield f"#{new()}=IFCRELDEFINESBYPROPERTIES('r',$,$,$,(#{terminal}),#{group});"
            beam = new()
            yield f"#{beam}=IFCBEAM('m',$,'Beam',$,$,#{level},$,$);"
            yield f"#{new()}=IFCRELAGGREGATES('r',$,$,$,#{storey},({listed(spaces)}));"
            yield f"#{new()}=IFCRELCONTAINEDINSPATIALSTRUCTURE('r',$,$,$,({listed([*inside, beam])}),#{storey});"
        yield f"#{new()}=IFCRELAGGREGATES('r',$,$,$,#{building},({listed(storeys)}));"
    yield f"#{new()}=IFCRELAGGREGATES('r',$,$,$,#{site},({listed(buildings)}));"
    yield "ENDSEC;\nEND-ISO-10303-21;"


def write(path: str, **size: int) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines(**size))
