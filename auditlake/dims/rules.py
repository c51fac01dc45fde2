"""Closed rule lists: rule-engine mapping, vendors, consent platforms."""

# Criteria of rules that carry no criterion tag.
RULE_CRITERIA = {
    "color-contrast": ("1.4.3",),
    "color-contrast-enhanced": ("1.4.6",),
    "image-alt": ("1.1.1",),
    "input-image-alt": ("1.1.1",),
    "area-alt": ("1.1.1", "2.4.4"),
    "label": ("3.3.2", "4.1.2"),
    "link-name": ("2.4.4", "4.1.2"),
    "button-name": ("4.1.2",),
    "document-title": ("2.4.2",),
    "html-has-lang": ("3.1.1",),
    "html-lang-valid": ("3.1.1",),
    "valid-lang": ("3.1.2",),
    "duplicate-id": ("4.1.1",),
    "duplicate-id-active": ("4.1.1",),
    "duplicate-id-aria": ("4.1.1",),
    "heading-order": ("1.3.1",),
    "landmark-one-main": ("1.3.1",),
    "region": ("1.3.1",),
    "list": ("1.3.1",),
    "listitem": ("1.3.1",),
    "definition-list": ("1.3.1",),
    "td-headers-attr": ("1.3.1",),
    "th-has-data-cells": ("1.3.1",),
    "aria-required-attr": ("4.1.2",),
    "aria-required-children": ("1.3.1", "4.1.2"),
    "aria-required-parent": ("1.3.1", "4.1.2"),
    "aria-roles": ("4.1.2",),
    "aria-valid-attr": ("4.1.2",),
    "aria-valid-attr-value": ("4.1.2",),
    "aria-hidden-focus": ("1.3.1", "4.1.2"),
    "aria-allowed-attr": ("4.1.2",),
    "bypass": ("2.4.1",),
    "frame-title": ("2.4.1", "4.1.2"),
    "meta-viewport": ("1.4.4",),
    "meta-refresh": ("2.2.1",),
    "autocomplete-valid": ("1.3.5",),
    "avoid-inline-spacing": ("1.4.12",),
    "scrollable-region-focusable": ("2.1.1",),
    "tabindex": ("2.4.3",),
    "select-name": ("4.1.2",),
    "object-alt": ("1.1.1",),
    "video-caption": ("1.2.2",),
    "audio-caption": ("1.2.1",),
    "blink": ("2.2.2",),
    "marquee": ("2.2.2",),
    "server-side-image-map": ("2.1.1",),
    "nested-interactive": ("4.1.2",),
    "form-field-multiple-labels": ("3.3.2",),
    "aria-command-name": ("4.1.2",),
    "aria-input-field-name": ("4.1.2",),
    "aria-toggle-field-name": ("4.1.2",),
    "aria-meter-name": ("1.1.1",),
    "aria-progressbar-name": ("1.1.1",),
    "aria-tooltip-name": ("4.1.2",),
    "svg-img-alt": ("1.1.1",),
    "role-img-alt": ("1.1.1",),
    "target-size": ("2.5.8",),
}

# Third-party widgets by element: vendor, tag ('' = any), attribute, operator, value.
# Operators: '=' whole value, '~' one of the blank-separated words, '*' contains, '^' starts with, '?' present.
VENDOR_RULES = [
    ("reCAPTCHA", "", "class", "~", "grecaptcha-badge"),
    ("reCAPTCHA", "", "id", "=", "g-recaptcha"),
    ("reCAPTCHA", "iframe", "src", "*", "recaptcha"),
    ("reCAPTCHA", "div", "class", "*", "grecaptcha"),
    ("UserWay", "", "id", "=", "userwayAccessibilityIcon"),
    ("UserWay", "", "class", "*", "userway"),
    ("UserWay", "", "id", "*", "userway"),
    ("UserWay", "iframe", "src", "*", "userway"),
    ("AccessiBe", "", "id", "=", "acsb-widget"),
    ("AccessiBe", "", "class", "~", "acsb-trigger"),
    ("AccessiBe", "", "class", "*", "accessibe"),
    ("Cookiebot", "", "id", "=", "CybotCookiebotDialog"),
    ("Google Maps", "iframe", "src", "*", "google.com/maps"),
    ("Google Maps", "iframe", "src", "*", "maps.google"),
    ("Google Maps", "", "class", "~", "gm-style"),
    ("Google Maps", "", "class", "^", "gm-"),
    ("Google Maps", "gmp-map", "", "?", ""),
    ("Google Maps", "", "class", "*", "gmp-internal"),
    ("YouTube", "iframe", "src", "*", "youtube.com"),
    ("YouTube", "iframe", "src", "*", "youtube-nocookie"),
    ("YouTube", "iframe", "src", "*", "youtu.be"),
    ("Vimeo", "iframe", "src", "*", "player.vimeo"),
    ("HubSpot", "", "id", "=", "hubspot-messages-iframe-container"),
    ("HubSpot", "", "class", "~", "hs-form"),
    ("HubSpot", "", "class", "*", "hbspt"),
    ("Intercom", "", "class", "~", "intercom-lightweight-app"),
    ("Intercom", "", "id", "=", "intercom-container"),
    ("Intercom", "", "class", "*", "intercom-"),
    ("Drift", "", "id", "=", "drift-widget"),
    ("Drift", "", "class", "*", "drift-frame"),
    ("Tawk.to", "", "id", "=", "tawkchat-container"),
    ("Tawk.to", "iframe", "src", "*", "tawk.to"),
    ("Crisp", "", "id", "=", "crisp-chatbox"),
    ("Crisp", "", "class", "*", "crisp-client"),
    ("Calendly", "", "class", "~", "calendly-inline-widget"),
    ("Calendly", "iframe", "src", "*", "calendly"),
    ("Typeform", "", "data-tf-widget", "?", ""),
    ("Typeform", "iframe", "src", "*", "typeform"),
    ("Trustpilot", "", "class", "~", "trustpilot-widget"),
    ("Google Tag Manager", "iframe", "src", "*", "googletagmanager"),
]

# Vendors recognisable from class and id tokens of a recorded chain, in order.
CHAIN_VENDORS = [
    ("Google Maps", r"^(gm-|gmp-|gmnoprint)"),
    ("reCAPTCHA", r"^(grecaptcha|g-recaptcha)"),
    ("UserWay", r"userway|^uw-"),
    ("AccessiBe", r"^acsb"),
    ("Cookiebot", r"(?i)^CybotCookiebot"),
    ("HubSpot", r"^(hs-form|hbspt)"),
    ("Intercom", r"^intercom-"),
    ("Crisp", r"^crisp-client"),
    ("Calendly", r"^calendly-"),
    ("Trustpilot", r"^trustpilot-"),
]

# Consent platforms in order: name, attribute, value, container selector.
CONSENT_PLATFORMS = [
    ("Iubenda", "id", "iubenda-cs-banner", "#iubenda-cs-banner, .iubenda-cs-container"),
    ("Iubenda", "class", "iubenda-cs-container", "#iubenda-cs-banner, .iubenda-cs-container"),
    ("OneTrust", "id", "onetrust-banner-sdk", "#onetrust-banner-sdk, #onetrust-consent-sdk"),
    ("OneTrust", "id", "onetrust-consent-sdk", "#onetrust-banner-sdk, #onetrust-consent-sdk"),
    ("Cookiebot", "id", "CybotCookiebotDialog", "#CybotCookiebotDialog"),
    ("Usercentrics", "id", "usercentrics-root", '#usercentrics-root, [data-testid="uc-container"]'),
    ("Usercentrics", "data-testid", "uc-container", '#usercentrics-root, [data-testid="uc-container"]'),
    ("Complianz", "id", "cmplz-cookiebanner-container", "#cmplz-cookiebanner-container, .cmplz-cookiebanner"),
    ("Complianz", "class", "cmplz-cookiebanner", "#cmplz-cookiebanner-container, .cmplz-cookiebanner"),
    ("CookieYes", "id", "cookie-law-info-bar", "#cookie-law-info-bar, .cky-consent-container"),
    ("CookieYes", "class", "cky-consent-container", "#cookie-law-info-bar, .cky-consent-container"),
    ("Borlabs", "id", "BorlabsCookieBox", "#BorlabsCookieBox, .borlabs-cookie-box"),
    ("Borlabs", "class", "borlabs-cookie-box", "#BorlabsCookieBox, .borlabs-cookie-box"),
    ("Cookie Notice (WP)", "id", "cookie-notice", "#cookie-notice"),
    ("Osano", "class", "osano-cm-dialog", ".osano-cm-dialog"),
    ("Didomi", "id", "didomi-host", "#didomi-host, .didomi-popup-container"),
    ("Didomi", "class", "didomi-popup-container", "#didomi-host, .didomi-popup-container"),
    # the last one needs a .klaro ancestor; the box table reports it as one joined class token
    ("Klaro", "class", "klaro/cookie-notice", ".klaro .cookie-notice"),
]
