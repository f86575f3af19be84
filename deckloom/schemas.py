"""Schemas of the slide graph, reports and manifests, as DDL texts."""

from __future__ import annotations


_FILL = ("struct<kind:string,color:string,opacity:double,angle_deg:double,"
         "stops:array<struct<position:double,color:string,opacity:double>>>")
_STROKE = "struct<color:string,opacity:double,width_px:double,dash:string>"
_BOX = "struct<x:double,y:double,width:double,height:double>"
_COMMANDS = ("array<struct<op:string,x:double,y:double,x1:double,y1:double,x2:double,y2:double>>")

# One wide nullable struct stands for the six element kinds.
ELEMENT = (
    f"struct<kind:string,id:string,name:string,layer:int,group_id:string,bounds:{_BOX},rotation_deg:double,"
    "text:string,font_family:string,font_size_pt:double,bold:boolean,italic:boolean,color:string,opacity:double,"
    "alignment:string,vertical_alignment:string,line_spacing:double,margin_px:double,preset:string,"
    f"fill:{_FILL},stroke:{_STROKE},corner_radius:double,x1:double,y1:double,x2:double,y2:double,"
    f"arrow_start:string,arrow_end:string,commands:{_COMMANDS},source_region:{_BOX},preserve_aspect:boolean,"
    "alt_text:string,content_type:string,component_id:string>"
)
SLIDE_KEYS = ["version", "source_width", "source_height", "background", "components", "elements",
              "reconstruction_notes"]
ELEMENT_KEYS = (
    "kind id name layer group_id bounds rotation_deg text font_family font_size_pt bold italic color opacity alignment "
    "vertical_alignment line_spacing margin_px preset fill stroke corner_radius x1 y1 x2 y2 arrow_start arrow_end commands "
    "source_region preserve_aspect alt_text content_type component_id").split()
COMPONENT_KEYS = ["id", "name", "elements"]
# Keys of the objects inside an element; the last two are arrays of objects.
NESTED_KEYS = {"bounds": ["x", "y", "width", "height"], "source_region": ["x", "y", "width", "height"],
               "stroke": ["color", "opacity", "width_px", "dash"], "fill": ["kind", "color", "opacity", "angle_deg", "stops"],
               "fill.stops": ["position", "color", "opacity"], "commands": ["op", "x", "y", "x1", "y1", "x2", "y2"]}
SLIDE = (
    f"version string, source_width int, source_height int, background {_FILL}, "
    f"components array<struct<id:string,name:string,elements:array<{ELEMENT}>>>, elements array<{ELEMENT}>, "
    "reconstruction_notes array<string>, _corrupt_record string")

REPORT = (
    "engine_version string, metric_version string, model string, quality_profile string, "
    "local_optimization string, powerpoint_validation_mode string, font_policy string, raster_policy string, "
    "requested_iterations int, target_score double, "
    "best_metrics struct<similarity_score:double,structural_score:double,pixel_mae:double,edge_mae:double,"
    "foreground_color_similarity:double>, "
    "audit struct<native_shape_objects:bigint,picture_objects:bigint,native_text_runs:bigint,"
    "flattened_slide:boolean,canvas_overflow_count:bigint>, "
    "ooxml_validation struct<compatible:boolean>, iterations array<struct<iteration:int>>")

MANIFEST = (
    "version int, canvas struct<width:int,height:int>, "
    "sources map<string,struct<url:string,landing_page:string,license_note:string>>, "
    "cases array<struct<id:string,source:string,page:int,category:string,difficulty:string>>")
