"""Table schemas of the particle model, as DDL texts (readers take them as they are)."""

IMAGES = (
    "image_id long, image string, nm_per_px double, detector string, structure double, "
    "pipeline string, width_px int, height_px int")

PARTICLES = (
    "image_id long, particle_id long, cx double, cy double, diam_px double, diam_nm double, "
    "major_px double, minor_px double, angle double, solidity double, facet_frac double, "
    "edge_cut double, touches_edge boolean, perim_px double, bright double, "
    "pattern_probs array<double>, user_measurable boolean, is_solid boolean, pattern string, "
    "excluded boolean, unclassified boolean, user_solid boolean")

LABEL_DOCUMENT = (
    "image string, stem string, detector string, nm_per_px double, confirmed string, "
    "signature string, labels array<struct<id:string,class:string,source:string,cx:double,"
    "cy:double,diam_nm:double,model_cls:string,conf:double,rank:int,n_items:int>>")

OVERRIDES = (
    "image_id long, particle_id long, kind string, value string")

SCALE_READINGS = (
    "image_id long, nm_per_px double, bar_px int, label_nm double, label_text string, ok boolean, "
    "note string, detector string, source string, hfw_nm double, mag long, mag_npp double, "
    "check string, instrument string, label_read string, version int")

THRESHOLDS = (
    "name string, value string")

LIBRARY = (
    "path string, name string, trail array<string>")

LABEL_PIXELS = (
    "image_id long, y int, x int, label int, grey int")
