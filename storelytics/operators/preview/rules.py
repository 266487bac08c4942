"""The selectors, in order of preference, that locate the parts of a product page."""

TITLE_METAS = [
    'meta[property="og:title"]',
    'meta[name="twitter:title"]',
    'meta[property="product:title"]',
    'meta[name="title"]',
]

TITLE_ELEMENTS = [
    ".product__title",
    ".product-single__title",
    "[data-product-title]",
    '[class*="product"][class*="title"]',
    '[class*="product"][class*="name"]',
    '[id*="product"][id*="title"]',
    '[id*="product"][id*="name"]',
    ".product-title",
    ".product-name",
    "#product-title",
    "#product-name",
    "h1.title",
    "h1.name",
    "h1:first-of-type",
    ".breadcrumb li:last-child",
    '[class*="breadcrumb"] span:last-child',
]

GENERIC_TITLES = [
    'meta[property="og:title"]',
    'meta[name="twitter:title"]',
    "h1",
    '[class*="product-title"]',
    '[class*="productTitle"]',
    '[class*="product-name"]',
    '[class*="productName"]',
    ".pdp_title",
    "#productTitle",
    ".pdp-name",
    ".pdp-title",
]

DESCRIPTIONS = [
    'meta[property="og:description"]',
    'meta[name="description"]',
    '[class*="description"]',
    '[class*="product-details"]',
    '[class*="productDetails"]',
    "#feature-bullets",
    ".pdp_description",
    '[data-testid*="description"]',
    ".pdp-product-description",
    ".index-productDescriptors",
]

IMAGES = [
    ".image-grid-imageContainer img",
    ".pdp-image img",
    ".img-responsive",
    "img[data-zoom-image]",
    "img[data-large-image]",
    "img[data-old-hires]",
    "[data-zoom-image]",
    'meta[property="og:image"]',
    'meta[name="twitter:image"]',
    'meta[property="product:image"]',
    ".product__image img",
    ".product-single__image img",
    ".product-featured-img",
    "#ProductPhotoImg",
    ".product-image img",
    "#product-image img",
    ".gallery-image img",
    "[data-main-image]",
    '[id*="product"][id*="image"]',
    '[class*="product"][class*="image"]',
]

IMAGE_ATTRIBUTES = ["data-zoom-image", "data-large-image", "data-old-hires", "content"]

FAVICONS = ['link[rel="shortcut icon"]', 'link[rel="icon"]']

# One retailer's own product pages.
SITE = {
    "title": [".pdp-title", ".pdp-name", "h1.title"],
    "description": [".pdp-product-description", ".index-productDescriptors", ".pdp-product-description-content"],
    "image": [".image-grid-imageContainer img", ".pdp-image img", ".img-responsive"],
}
SITE_DEFAULTS = {"title": "Product Title Not Available", "description": "No description available"}
