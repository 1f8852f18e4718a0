import pytest

from gaugeworks.building import place, resolve, source, spf

HEAD = "ISO-10303-21;\nHEADER;\nFILE_NAME('it''s /* no comment */ DATA;','',(''),(''),'','','');\nENDSEC;\n"


def model(*lines):
    return HEAD + "DATA;\n" + "\n".join(lines) + "\nENDSEC;\nEND-ISO-10303-21;\n"


def placement(n, parent, x, y, z):
    return [f"#{n}=IFCLOCALPLACEMENT({parent},#{n + 1});", f"#{n + 1}=IFCAXIS2PLACEMENT3D(#{n + 2},$,$);", f"#{n + 2}=IFCCARTESIANPOINT(({x}.,{y}.,{z}.));"]


CHAIN = [
    "#1=IFCPROJECT('g',$,'P',$,$,$,$,$,$);",
    "#2=IFCBUILDING('g',$,'B',$,$,#10,$,$,.ELEMENT.,$,$,$);",
    "#3=IFCBUILDINGSTOREY('g',$,'S',$,$,#20,$,$,.ELEMENT.,6.5);",
    "#4=IFCSPACE('g',$,'R',$,$,#30,$,$,.ELEMENT.,.INTERNAL.,$);",
    "#5=IfcWall('g',$,'W',$,$,#30,$,$);",
    *placement(10, "$", 0, 0, 0), *placement(20, "#10", 5, 0, 3), *placement(30, "#20", 1, 2, 0),
    "#40=IFCRELAGGREGATES('g',$,$,$,#1,(#2));", "#41=IFCRELAGGREGATES('g',$,$,$,#2,(#3));", "#42=IFCRELAGGREGATES('g',$,$,$,#3,(#4));",
    "#43=IFCRELCONTAINEDINSPATIALSTRUCTURE('g',$,$,$,(#5),#4);", "#44=IFCRELAGGREGATES('g',$,$,$,#2,(#5));",
]


def load(spark, tmp_path, text, name="m.ifc"):
    (tmp_path / name).write_text(text)
    return source.entities(spark, str(tmp_path / name))


def test_values():
    text = model("#1 = X /* a /* nested */ comment */ ($,*,-3,+1.5E-2,'it''s',.T.,#7,(1,(2,#3)),IFCLABEL('v'),IFCX((1.,2.)),\"0F\");")
    [(number, name, args)] = spf.parse(text)
    assert (number, name) == (1, "X")
    assert [a.kind for a in args] == ["unset", "derived", "int", "real", "string", "enum", "ref", "list", "string", "list", "enum"]
    assert args[3].num == 0.015 and args[4].str == "it's" and args[6].ref == 7 and args[7].items[1].items[1].ref == 3 and args[8].str == "v" and len(args[9].items) == 2


@pytest.mark.parametrize("text,error", [
    (HEAD, spf.MissingDataSection), (model("#1=A();", "#1=B();"), spf.DuplicateEntityId), (model("#1=A('open);"), spf.UnterminatedString),
    (model("#1=A(1.2.3);"), spf.InvalidNumber), (model("#1=A(@);"), spf.UnexpectedCharacter), (model("#1 A();"), spf.UnexpectedCharacter),
    (HEAD + "DATA;\n#1=A(1", spf.UnexpectedEnd), (model("#1=A(/* open );"), spf.UnexpectedEnd), (model("1=A();"), spf.UnexpectedCharacter),
])
def test_errors(text, error):
    with pytest.raises(error):
        list(spf.parse(text))


def test_chain(spark, tmp_path):
    b = resolve.resolve(load(spark, tmp_path, model(*CHAIN)))
    found = {r.ifc_id: r for r in b.elements.collect()}
    at = lambda i: (found[i].x, found[i].y, found[i].z)
    assert len(found) == 5 and at(3) == (5, 0, 3) and at(4) == at(5) == (6, 2, 3) and at(1) == (0, 0, 0)
    assert found[5].parent_id == 4 and found[1].parent_id is None and found[5].element_type == "wall"
    assert {r.zone_id: (r.zone_type, r.floor_level) for r in b.zones.collect()} == {3: ("storey", 6.5), 4: ("space", 6.5)}
    assert {r.zone_id: r.floor_id for r in b.zone_floor.collect()} == {3: 3, 4: 3}


def test_broken_cyclic_and_deep_placements(spark, tmp_path):
    deep = [line for k in range(66) for line in placement(1000 + 3 * k, f"#{1000 + 3 * (k - 1)}" if k else "$", 1, 0, 0)]
    text = model(
        "#1=IFCWALL('g',$,'a',$,$,#10,$,$);", "#10=IFCLOCALPLACEMENT(#999,#11);", "#11=IFCAXIS2PLACEMENT3D(#12,$,$);", "#12=IFCCARTESIANPOINT((7.,7.,7.));",
        "#2=IFCWALL('g',$,'b',$,$,#20,$,$);", "#20=IFCLOCALPLACEMENT(#21,#11);", "#21=IFCLOCALPLACEMENT(#20,#11);",
        "#3=IFCWALL('g',$,'c',$,$,#30,$,$);", "#30=IFCLOCALPLACEMENT($,#998);", "#4=IFCWALL('g',$,'d',$,$,#40,$,$);", "#40=IFCLOCALPLACEMENT($,#11);",
        f"#5=IFCWALL('g',$,'e',$,$,#{1000 + 3 * 64},$,$);", f"#6=IFCWALL('g',$,'f',$,$,#{1000 + 3 * 65},$,$);", "#7=IFCDOOR('g',$,'g',$,$,#40,$,$);", *deep,
    )
    entities = load(spark, tmp_path, text)
    found = {r.ifc_id: (r.x, r.y, r.z) for r in resolve.resolve(entities).elements.collect()}
    assert found == {1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (7, 7, 7), 5: (65, 0, 0), 6: (0, 0, 0)}


def test_orphan_space_and_equipment(spark, tmp_path):
    text = model(
        "#1=IFCSPACE('g',$,'R',$,$,$,$,$,$,$,$);", "#2=IFCFLOWTERMINAL('g',$,'T',$,$,$,$,$);", "#3=IFCALARM('g',$,'A',$,$,$,$,$);",
        "#10=IFCPROPERTYSINGLEVALUE('Manufacturer',$,IFCLABEL('late'),$);", "#11=IFCPROPERTYSINGLEVALUE('Type Name',$,IFCLABEL('type'),$);", "#12=IFCPROPERTYSINGLEVALUE('Manufacturer',$,IFCLABEL('early'),$);",
        "#13=IFCPROPERTYSINGLEVALUE('Family and Type',$,IFCLABEL('best'),$);", "#14=IFCPROPERTYSINGLEVALUE('Family Name',$,IFCREAL(3.),$);",
        "#20=IFCPROPERTYSET('g',$,'s',$,(#10,#13));", "#21=IFCPROPERTYSET('g',$,'s',$,(#12,#11,#14));", "#22=IFCELEMENTQUANTITY('g',$,'s',$,$,(#10));",
        "#30=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#2),#20);", "#29=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#2),#21);", "#31=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#3),#22);",
    )
    b = resolve.resolve(load(spark, tmp_path, text))
    assert {r.element_id: (r.manufacturer, r.model) for r in b.equipment.collect()} == {2: ("early", "best"), 3: ("", "")}
    assert b.zones.first().floor_level == 0.0 and b.zone_floor.first().floor_id == 1


def test_placement(spark, tmp_path):
    lines = [*CHAIN[:4], *placement(10, "$", 10, 20, 0), *placement(20, "$", 0, 0, 0), *placement(30, "$", 10, 20, 0), *CHAIN[-5:-2],
             "#6=IFCFLOWSEGMENT('g',$,'F',$,$,#30,$,$);", "#7=IFCBEAM('g',$,'M',$,$,#30,$,$);", "#50=IFCRELCONTAINEDINSPATIALSTRUCTURE('g',$,$,$,(#6,#7),#3);"]
    b = resolve.resolve(load(spark, tmp_path, model(*lines)))
    got = place.place(b.elements, b.zones)
    sensors = got.sensors.orderBy("sensor_id").collect()
    assert [(r.sensor_id, r.sensor_type, r.element_id) for r in sensors] == [(0, "temperature", 4), (1, "humidity", 4), (2, "occupancy", 4), (3, "flow", 6), (4, "flow", 6), (5, "temperature", 6), (6, "structural", 7)]
    where = {r.sensor_id: (r.zone_id, r.x, r.y) for r in got.locations.collect()}
    assert [where[i][0] for i in range(7)] == [4, 4, 4, 3, 3, 3, 3] and set(w[1:] for w in where.values()) == {(10.0, 20.0)}
    large = b.zones.withColumn("area_m2", b.zones.floor_level * 0 + 300)
    assert place.place(b.elements.filter("element_type = 'space'"), large).sensors.count() == 9
    assert place.place(b.elements, b.zones, rules={}).sensors.count() == 0


def test_half_counts_round_up(spark):
    from pyspark.sql import functions as F

    from gaugeworks.functions.scalars import placed_count

    got = [spark.range(1).select(placed_count(F.lit(a), F.lit(1.0))).first()[0] for a in (50.0, 150.0, 250.0, 1.0)]
    assert got == [1, 2, 3, 1]


def test_data_source_and_many_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.ifc").write_text(model(*CHAIN))
    spark.dataSource.register(source.SpfDataSource)
    assert spark.read.format("ifc").load(str(tmp_path)).count() == 3 * len(CHAIN) == source.entities(spark, str(tmp_path)).count()
    assert resolve.resolve(source.entities(spark, str(tmp_path))).elements.count() == 15


def test_generated_building(spark, tmp_path):
    from gaugeworks.building import write

    write.write(str(tmp_path / "large.ifc"), blocks=3, floors=4, rooms=5)
    b = resolve.resolve(source.entities(spark, str(tmp_path / "large.ifc")))
    assert b.elements.count() == 1 + 1 + 3 + 12 + 60 * 4 + 12 and b.zones.count() == 72
    assert b.zones.filter("zone_type = 'space' and floor_level = 10.5").count() == 15
    assert b.zone_floor.select("floor_id").distinct().count() == 12
    assert b.equipment.filter("manufacturer like 'Maker %' and model like 'Type %'").count() == 60
    room = b.elements.filter("name = 'Room 2.3.4'").first()
    assert (room.x, room.y, room.z) == (2 * 80 + 4 * 6, 0, 3 * 3.5)
