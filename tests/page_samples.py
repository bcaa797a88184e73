"""Small hand-made pages."""

import json

LAMP_URL = "https://bikes.test/p/night-rider-lamp"

LAMP_LD = {
    "@type": "Product",
    "sku": "NRL",
    "brand": {"name": "Nordlys"},
    "name": "Night rider lamp",
    "image": ["https://cdn.bikes.test/lamp-front.png", "https://cdn.bikes.test/placeholder-wide.png"],
    "description": "Front &amp; rear lamp set,\nRun time: 40 hours\nwith clips",
    "offers": {"price": "18.20", "priceCurrency": "SEK", "availability": "http://schema.org/OutOfStock"},
}
LAMP_CRUMBS = {
    "@type": "BreadcrumbList",
    "itemListElement": [{"name": n} for n in ("Home page", "Cycling", "Lighting", "Lamp sets", "By battery", "Night rider lamp")],
}
LAMP_VARIANTS = {
    "amber": {
        "sku": "NRL-AM",
        "id": 8,
        "manufacturer_name": "Nordlys",
        "name": "Night rider   lamp, amber",
        "description": "Amber glass, 2 pieces per pack",
        "product_price": "21.75000",
        "stock_availability_label": "Two weeks",
        "main_image": "https://cdn.bikes.test/lamp-amber.png",
    }
}


def ld(value):
    return f'<script type="application/ld+json">\n{json.dumps(value)}\n</script>'


def page(*records, variants=None, gallery=None, tail=""):
    parts = [ld(r) for r in records]
    script = ""
    if gallery is not None:
        script += f"initialImages: {json.dumps(gallery)},\n"
    if variants is not None:
        text = variants if isinstance(variants, str) else json.dumps(variants)
        script += f"window.masterData = {json.dumps(text)};\n"
    return f"<html><head>{''.join(parts)}</head><body><script>{script}</script>{tail}</body></html>"


LAMP_PAGE = page(
    LAMP_CRUMBS,
    LAMP_LD,
    variants=LAMP_VARIANTS,
    gallery=[{"img": "https://cdn.bikes.test/lamp-front.png"}, {"full": "https://cdn.bikes.test/lamp-box.png"}],
)
